"""Features read out of catalog text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import rules


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def any_of(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit.cast("double")


def first_hit(text: Column, pairs, default) -> Column:
    out = None
    for word, value in pairs:
        out = F.when(F.contains(text, F.lit(word)), F.lit(value)) if out is None else out.when(F.contains(text, F.lit(word)), F.lit(value))
    return out.otherwise(F.lit(default))


def model_inputs(content: Column) -> dict[str, Column]:
    """The sixteen inputs of the price model; fit and score share this one definition."""
    content = F.coalesce(content, F.lit(""))
    text = F.lower(content)
    at = F.instr(text, "value:")
    value = F.when(at > 0, F.coalesce(first_match(F.substring(text, at + 6, F.lit(30)), r"[0-9]+\.?[0-9]*", 0).cast("double"), F.lit(0.0))).otherwise(0.0)
    pack = F.coalesce(*(first_match(text, p).cast("double") for p in rules.PACK_PATTERNS), F.lit(1.0))
    title = F.coalesce(F.get(F.filter(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, r"\s", "") != ""), F.lit(0)), F.lit(""))
    chars, words = F.length(content).cast("double"), F.regexp_count(content, F.lit(r"\S+")).cast("double")
    return {
        "value": value,
        "unit_score": first_hit(text, rules.UNIT_SCORES, 0.0).cast("double"),
        "pack_qty": pack,
        "title_words": F.regexp_count(title, F.lit(r"\S+")).cast("double"),
        "title_chars": F.length(title).cast("double"),
        "total_chars": chars,
        "total_words": words,
        "digit_ratio": F.regexp_count(content, F.lit("[0-9]")) / F.greatest(chars, F.lit(1.0)),
        "brand_hit": any_of(text, rules.MODEL_BRANDS),
        "category": first_hit(text, rules.MODEL_CATEGORIES, 0).cast("double"),
        "has_size": any_of(text, rules.SIZE_WORDS),
        "has_weight": any_of(text, rules.WEIGHT_WORDS),
        "has_volume": any_of(text, rules.VOLUME_WORDS),
        "value_x_pack": value * F.greatest(pack, F.lit(1.0)),
        "log_value": F.log1p(value),
        "log_total_words": F.log1p(words),
    }


def pack_quantity(text: Column) -> Column:
    """First quantity pattern that matches: struct(value double, unit, confidence, method); null without a match."""
    found = []
    for pattern, value, unit, confidence, method in rules.IPQ:
        word = F.lower(F.regexp_replace(F.coalesce(first_match(text, pattern, unit), F.lit("piece")), r"\s+", " ")) if unit else F.lit("piece")
        found.append(F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, value).cast("double").alias("value"), word.alias("unit"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))))
    return F.coalesce(*found)


def canonical_unit(unit: Column) -> Column:
    """struct(unit, factor) from the fixed unit table; an unknown unit is a piece."""
    table = F.create_map(*(x for u, c, f in rules.UNITS for x in (F.lit(u), F.struct(F.lit(c).alias("unit"), F.lit(f).alias("factor")))))
    return F.coalesce(F.element_at(table, F.coalesce(unit, F.lit(""))), F.struct(F.lit("piece").alias("unit"), F.lit(1.0).alias("factor")))


def parser_quantity(text: Column) -> Column:
    text = F.lower(text)
    return F.coalesce(*(F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).cast("double").alias("value"), F.round(F.lit(1.0 - 0.1 * i), 1).alias("confidence"), F.lit(f"pattern_{i + 1}").alias("method"))) for i, p in enumerate(rules.PARSER_IPQ)))


def metres(value: Column, unit: Column) -> Column:
    factor = F.element_at(F.create_map(*(x for u, f in rules.LENGTHS for x in (F.lit(u), F.lit(f)))), unit)
    return value.cast("double") * F.coalesce(factor, F.lit(1.0))


def dimensions(text: Column) -> dict[str, Column]:
    """Length, width, height, volume, area, diameter and radius in metres; a labelled diameter goes before L x W.

    ``labelled`` is the single labelled length (length, width, height, depth, or a diameter in feet) of a text that has
    none of these, and ``labelled_as`` its label; one number alone does not make ``has_dimensions``."""
    text = F.lower(text)
    part = lambda p, i: metres(F.regexp_extract(text, p, 2 * i + 1), F.regexp_extract(text, p, 2 * i + 2))
    lwh, lw, dia = (text.rlike(p) for p in (rules.LWH, rules.LW, rules.DIAMETER))
    a, b, c = (part(rules.LWH, i) for i in range(3))
    p, q = (part(rules.LW, i) for i in range(2))
    d = part(rules.DIAMETER, 0)
    alone = text.rlike(rules.LABELLED) & ~(lwh | dia | lw)
    return {
        "length": F.when(lwh, a).when(dia, None).when(lw, p),
        "width": F.when(lwh, b).when(dia, None).when(lw, q),
        "height": F.when(lwh, c),
        "volume": F.when(lwh, a * b * c),
        "area": F.when(lwh, None).when(dia, F.lit(3.14159) * (d / 2) * (d / 2)).when(lw, p * q),
        "diameter": F.when(lwh, None).when(dia, d),
        "radius": F.when(lwh, None).when(dia, d / 2),
        "labelled": F.when(alone, metres(F.regexp_extract(text, rules.LABELLED, 2), F.regexp_extract(text, rules.LABELLED, 3))),
        "labelled_as": F.when(alone, F.regexp_extract(text, rules.LABELLED, 1)),
        "has_dimensions": lwh | dia | lw,
    }


def lexicon(text: Column, lists: list[str]) -> Column:
    """Distinct hits of the word lists, sorted; a hit inside a longer hit is dropped."""
    text = F.lower(text)
    hits = F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(rf"\b(?:{words})\b"), F.lit(0)) for words in lists))))
    return F.filter(hits, lambda h: ~F.exists(hits, lambda o: (o != h) & F.contains(o, h)))


def brand(text: Column) -> Column:
    text = F.lower(text)
    return F.coalesce(*(F.when(text.rlike(rf"\b({words})\b"), F.struct(F.regexp_extract(text, rf"\b({words})\b", 1).alias("brand"), F.lit(kind).alias("kind"))) for words, kind in rules.BRANDS))


def category(text: Column) -> Column:
    """Category of the highest confidence; the first rule wins ties."""
    text = F.lower(text)
    ranked = sorted(rules.CATEGORIES, key=lambda r: -r[2])
    return F.coalesce(*(F.when(text.rlike(rf"\b(?:{words})\b"), F.struct(F.lit(name).alias("category"), F.lit(confidence).alias("confidence"))) for words, name, confidence in ranked))


def specifications(text: Column) -> Column:
    """map of spec name to struct(value, unit, raw); weights in grams."""
    text = F.lower(text)
    entries = []
    for name, pattern in rules.SPECS:
        value, unit = F.regexp_extract(text, pattern, 1).cast("double"), F.regexp_extract(text, pattern, 2)
        if name == "weight":
            c = canonical_unit(unit)
            value, unit = value * c["factor"], F.lit("gram")
        entries.append(F.when(text.rlike(pattern), F.struct(F.lit(name), F.struct(value.alias("value"), unit.alias("unit"), F.regexp_extract(text, pattern, 0).alias("raw")))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def text_words(text: Column) -> dict[str, Column]:
    """The trimmed text and its words, which ``text_statistics`` starts from."""
    text = F.btrim(F.coalesce(text, F.lit("")))
    return {"text": text, "words": F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))}


def text_statistics(text: Column, words: Column) -> dict[str, Column]:
    """Counts over the whole text."""
    chars = F.greatest(F.length(text), F.lit(1))
    times = lambda pattern: F.regexp_count(text, F.lit(pattern))
    n = F.size(words)
    least = F.greatest(n, F.lit(1))
    # characters of a class: what is missing once they are gone, which takes no array of them
    of = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))) / chars
    return {
        "char_count": F.length(text).cast("long"),
        "word_count": n.cast("long"),
        "sentence_count": times(r"[^.!?\s][^.!?]*").cast("long"),  # stretches between end marks that hold more than spaces
        "avg_word_length": F.when(n > 0, F.length(F.regexp_replace(text, r"\s+", "")) / n).otherwise(0.0),
        "avg_sentence_length": n / (times("[.!?]+") + 1),
        "uppercase_ratio": of(r"\p{Lu}"),
        "lowercase_ratio": of(r"\p{Ll}"),
        "digit_ratio": of("[0-9]"),
        "punctuation_ratio": of(r"[!-/:-@\[-`{-~]"),
        "whitespace_ratio": of(r"\s"),
        "unique_word_ratio": F.size(F.array_distinct(words)) / least,
        "long_word_ratio": times(r"\S{7,}") / least,
        "short_word_ratio": (n - times(r"\S{4,}")) / least,
        "has_numbers": text.rlike("[0-9]"),
        "has_special_chars": text.rlike(r"[!@#$%^&*()]"),
        "has_urls": text.rlike(r"https?://|www\."),
        "has_email": text.rlike(rules.EMAIL),
    }


def readability_counts(text: Column) -> dict[str, Column]:
    """Sentences, words, letters, and the text with letters, digits and underscores that are no vowels as x, so that syllables
    are counted by plain patterns without backtracking."""
    text = F.btrim(F.coalesce(text, F.lit("")))
    plain = "bcdfghjklmnpqrstvwxz0123456789_"
    shape = F.regexp_replace(F.translate(F.lower(text), plain, "x" * len(plain)), r"[[\p{L}\p{N}]&&[^aeiouyx]]", "x")
    return {"sentences": F.regexp_count(text, F.lit("[.!?]+")) + 1, "words": F.regexp_count(text, F.lit(r"\S+")), "letters": F.length(F.regexp_replace(text, r"\s", "")), "shape": shape}


def syllables(shape: Column) -> Column:
    """A word has a syllable for each vowel group, less one for a final e that is not its only group, and one at least. Over
    a text that is: vowel groups, plus words without one, less words that end in e after an earlier group."""
    groups = F.regexp_count(shape, F.lit("[aeiouy]+"))
    none = F.regexp_count(shape, F.lit("(?<![aeiouyx])x++(?![aeiouy])"))
    silent = F.regexp_count(shape, F.lit("[aeiouy]x++[aeiouy]*+(?<=e)(?!x)"))
    return F.greatest(groups + none - silent, F.lit(1))


def readability(sentences: Column, words: Column, letters: Column, beats: Column) -> dict[str, Column]:
    """Flesch ease and grade, automated readability and Coleman-Liau; words without vowels count one syllable."""
    some = words > 0
    score = lambda c: F.when(some, F.greatest(c, F.lit(0.0))).otherwise(0.0)
    return {
        "flesch_reading_ease": F.least(score(206.835 - 1.015 * words / sentences - 84.6 * beats / words), F.lit(100.0)),
        "flesch_kincaid_grade": score(0.39 * words / sentences + 11.8 * beats / words - 15.59),
        "automated_readability_index": score(4.71 * letters / words + 0.5 * words / sentences - 21.43),
        "coleman_liau_index": score(0.0588 * (letters / words * 100) - 0.296 * (sentences / words * 100) - 15.8),
    }
