"""License scans by a positional rare-token index, in DataFrame functions only.

Licence words are ranked by IDF over all documents. The index posts each template under the ``POSTED`` rarest words of its
mandatory key phrases, with their offsets. A file looks up the postings of the rare words it holds; a hit gives a relative
position of the template in the file, and the postings of a template are intersected by that position. At the positions
left all key phrases must stand, word for word. A template's key phrases bring its rare words with them at their offsets,
so no place is missed.

Base templates are the phrases of the contract. The longer ones are licence notices that add labels of their own: such a
template is reported when its key phrases stand and at least ``COVERAGE`` of its words are in place; ``score`` is the best
share of words in place over all places where a longer template's key phrases stand (0 without one)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COVERAGE = 0.8
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# label, text, mandatory key phrases
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ["gnu lesser general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("mit-notice", "released under the mit license", ["mit license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ["permission is hereby granted free of charge to any person obtaining a copy", "without restriction including without limitation the rights to use"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute this software", "this permission notice appear in all copies"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "redistributions of source code must retain"]),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license", "you may not use this file except in compliance with the license"]),
    ("gpl-3.0-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "free software foundation", "version 3"]),
    ("gpl-2.0-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "free software foundation", "version 2"]),
    ("agpl-3.0-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license", "version 3"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license", "if a copy of the mpl was not distributed"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["unencumbered software released into the public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", ["in no event will the authors be held liable", "permission is granted to anyone to use this software"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy", "accompanying documentation covered by this license"]),
]
POSTED = 2


def offset_of(phrase: list[str], text: list[str]) -> int:
    return next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)


def templates() -> list[dict]:
    """Every template with its words, label and key phrases as (offset, words); base templates are their own key phrase."""
    out = [{"label": label, "base": True, "words": p.split(), "keys": [(0, p.split())]} for p, label in BASE]
    for label, text, keys in TEMPLATES:
        out.append({"label": label, "base": False, "words": text.split(), "keys": [(offset_of(k.split(), text.split()), k.split()) for k in keys]})
    return out


def text_array(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def licence_word_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each licence word: one row per word of the templates, whatever the corpus."""
    held = words.select(F.explode(F.array_intersect(F.col("words"), text_array(vocabulary))).alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def postings(known: list[dict], df: dict[str, int]) -> list[dict[str, list[tuple[int, int]]]]:
    """For each rank up to ``POSTED``: word -> (template, offset), every template under its word of that rank."""
    index: list[dict] = [{} for _ in range(POSTED)]
    for n, t in enumerate(known):
        offsets = {}
        for o, key in t["keys"]:
            for i, w in enumerate(key):
                offsets.setdefault(w, o + i)
        for rank, w in enumerate(sorted(offsets, key=lambda w: (df.get(w, 0), w))[:POSTED]):
            index[rank].setdefault(w, []).append((n, offsets[w]))
    return index


def in_place(key: list[str], at: Column) -> Column:
    return (at >= 0) & (F.slice("words", F.greatest(at, F.lit(0)) + 1, len(key)) == text_array(key))


ZERO = 1 << 20  # a template may start before the file


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per
    row of ``docs``.

    A-Z are lower-cased; a null text is empty. Without a base place first_word and last_word are null; without labels the
    label columns are empty strings. Rows are judged one by one, so repeated rows and ids give repeated results. Extra
    columns are ignored; an empty table gives an empty result."""
    known = templates()
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    words = docs.select("doc_id", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    vocabulary = sorted({w for t in known for _, key in t["keys"] for w in key})
    index = postings(known, licence_word_counts(words, vocabulary))
    rare = sorted({w for ranked in index for w in ranked})
    none = F.array().cast("array<bigint>")
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    # most texts hold few of the rare words; the positions are taken of those that hold any
    found = words.withColumn("hits", F.when(F.arrays_overlap("words", text_array(rare)), hits))

    def places(ranked: dict) -> Column:
        """Template and relative position, as one number, of every hit."""
        table = F.create_map(*chain.from_iterable((F.lit(w), F.array(*(F.lit((n << 32) + ZERO - o) for n, o in at))) for w, at in ranked.items()))
        return F.coalesce(F.flatten(F.transform("hits", lambda h: F.coalesce(F.transform(F.try_element_at(table, h["w"]), lambda p: p + h["i"]), none))), none)

    common = places(index[0])
    for ranked in index[1:]:
        common = F.array_intersect(common, places(ranked))
    found = found.withColumn("places", F.when(F.size("hits") > 0, common).otherwise(none))

    def stands(n: int) -> Column:
        """Starts of template n at which all of its key phrases stand."""
        mine = F.transform(F.filter("places", lambda p: F.shiftright(p, 32) == n), lambda p: (p.bitwiseAND(F.lit((1 << 32) - 1)) - ZERO).cast("int"))

        def check(s):
            ok = F.lit(True)
            for o, key in known[n]["keys"]:
                ok = ok & in_place(key, s + o)
            return ok

        return F.filter(mine, check)

    base = [n for n, t in enumerate(known) if t["base"]]
    longer = [n for n, t in enumerate(known) if not t["base"]]
    found = found.select("doc_id", "words", *(stands(n).alias(f"at{n}") for n in range(len(known))))

    def coverage(n: int) -> Column:
        """Greatest share of the words of template n that stand in place."""
        want = known[n]["words"]

        def share(s):
            skip = F.greatest(-s, F.lit(0))
            same = F.zip_with(F.slice("words", F.greatest(s, F.lit(0)) + 1, F.lit(len(want)) - skip), F.slice(text_array(want), skip + 1, F.lit(len(want)) - skip), lambda a, b: F.coalesce(a == b, F.lit(False)))
            return F.size(F.filter(same, lambda x: x)) / F.lit(float(len(want)))

        return F.coalesce(F.array_max(F.transform(f"at{n}", share)), F.lit(0.0))

    found = found.select("doc_id", "words", *(f"at{n}" for n in base), *(F.when(F.size(f"at{n}") > 0, coverage(n)).otherwise(0.0).alias(f"share{n}") for n in longer))
    all_base = F.concat(*(F.col(f"at{n}") for n in base))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"at{n}") > 0, F.lit(known[n]["label"])) for n in base)))
    own_labels = F.array_compact(F.array(*(F.when(F.col(f"share{n}") >= COVERAGE, F.lit(known[n]["label"])) for n in longer)))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(all_base).cast("long").alias("n_base"),
        F.array_min(all_base).cast("long").alias("first_word"),
        F.array_max(all_base).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own_labels)).alias("labels"),
        F.greatest(F.lit(0.0), *(F.col(f"share{n}") for n in longer)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _starts(key: str) -> str:
    k = key.split()
    return f"list_filter(range(0, len(words)), lambda i: words[i + 1 : i + {len(k)}] = [{', '.join(repr(w) for w in k)}])"


def _share(t: dict) -> str:
    n = len(t["words"])
    ok = " AND ".join(f"s + {o} >= 0 AND words[greatest(s + {o}, 0) + 1 : greatest(s + {o}, 0) + {len(k)}] = [{', '.join(repr(w) for w in k)}]" for o, k in t["keys"])
    right = f"list_sum(list_transform(range(0, {n}), lambda j: CASE WHEN s + j >= 0 AND words[greatest(s + j, 0) + 1] = [{', '.join(repr(w) for w in t['words'])}][j + 1] THEN 1 ELSE 0 END))"
    return f"coalesce(list_max(list_transform(list_filter(list_transform({_starts(' '.join(t['keys'][0][1]))}, lambda i: i - {t['keys'][0][0]}), lambda s: {ok}), lambda s: {right} / CAST({n} AS DOUBLE))), 0)"


def op1_sql() -> str:
    known = templates()
    base = [t for t in known if t["base"]]
    longer = [t for t in known if not t["base"]]
    cols = ", ".join(f"{_starts(' '.join(t['words']))} AS b{i}" for i, t in enumerate(base))
    shares = ", ".join(f"{_share(t)} AS s{i}" for i, t in enumerate(longer))
    flat = "flatten([" + ", ".join(f"b{i}" for i in range(len(base))) + "])"
    base_labels = "[" + ", ".join(f"CASE WHEN len(b{i}) > 0 THEN {t['label']!r} END" for i, t in enumerate(base)) + "]"
    own = "[" + ", ".join(f"CASE WHEN s{i} >= {COVERAGE} THEN {t['label']!r} END" for i, t in enumerate(longer)) + "]"
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    join = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({x}, lambda l: l IS NOT NULL))), ','), '')"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
f AS (SELECT doc_id, words, {cols}, {shares} FROM w)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len({flat}) AS BIGINT) AS n_base, CAST(list_min({flat}) AS BIGINT) AS first_word, CAST(list_max({flat}) AS BIGINT) AS last_word,
{join(base_labels)} AS base_labels, {join(f'list_concat({base_labels}, {own})')} AS labels, greatest({', '.join(f's{i}' for i in range(len(longer)))}) AS score FROM f
"""
