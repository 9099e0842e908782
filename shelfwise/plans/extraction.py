"""Queries over text, pattern and math extraction."""

from __future__ import annotations


from pyspark.sql import functions as F

from shelfwise.functions import extract, rules
from shelfwise.operators import features
from shelfwise.plans.registry import case_contains, contains_any, lit, query
from shelfwise.sources.tables import predictions, products, spread_products, table

C = "catalog_content"
L = f"lower({C})"


def num(text: str, pattern: str, group: int = 1) -> str:
    return f"CAST(nullif(regexp_extract({text}, {lit(pattern)}, {group}), '') AS DOUBLE)"


def count_of(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {lit(pattern)})) AS DOUBLE)"


_INPUTS = "value unit_score pack_qty title_words title_chars total_chars total_words digit_ratio brand_hit category has_size has_weight has_volume value_x_pack log_value log_total_words"
_title = f"coalesce(list_filter(string_split({C}, chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')[1], '')"
INPUTS_SQL = f"""SELECT *, value * greatest(pack_qty, 1) AS value_x_pack, ln(1 + value) AS log_value, ln(1 + total_words) AS log_total_words FROM (
SELECT sample_id, CASE WHEN strpos({L}, 'value:') > 0 THEN coalesce({num(f"substr({L}, strpos({L}, 'value:') + 6, 30)", "[0-9]+[.]?[0-9]*", 0)}, 0) ELSE 0 END AS value,
{case_contains(L, rules.UNIT_SCORES, 0.0)} AS unit_score, coalesce({', '.join(num(L, p) for p in rules.PACK_PATTERNS)}, 1) AS pack_qty,
{count_of(_title, r'\S+')} AS title_words, length({_title}) AS title_chars, length({C}) AS total_chars, {count_of(C, r'\S+')} AS total_words,
{count_of(C, '[0-9]')} / greatest(length({C}), 1) AS digit_ratio, CAST({contains_any(L, rules.MODEL_BRANDS)} AS INT) AS brand_hit, {case_contains(L, rules.MODEL_CATEGORIES, 0)} AS category,
CAST({contains_any(L, rules.SIZE_WORDS)} AS INT) AS has_size, CAST({contains_any(L, rules.WEIGHT_WORDS)} AS INT) AS has_weight, CAST({contains_any(L, rules.VOLUME_WORDS)} AS INT) AS has_volume FROM products)"""


@query("catalog_features16", INPUTS_SQL, _INPUTS)
def catalog_features16(spark, d):
    return products(spark, d).select("sample_id", *(c.alias(n) for n, c in extract.model_inputs(F.col(C)).items()))


def ipq_sql(text: str) -> str:
    """A struct by the first pattern that matches."""
    out = []
    for p, v, u, confidence, method in rules.IPQ:
        unit = f"lower(regexp_replace(coalesce(nullif(regexp_extract({text}, {lit(p)}, {u}), ''), 'piece'), '\\s+', ' ', 'g'))" if u else "'piece'"
        out.append(f"WHEN regexp_matches({text}, {lit(p)}) THEN {{'value': CAST(regexp_extract({text}, {lit(p)}, {v}) AS DOUBLE), 'unit': {unit}, 'confidence': CAST({confidence} AS DOUBLE), 'method': '{method}'}}")
    return "CASE " + " ".join(out) + " END"


_case_unit = "CASE {u} " + " ".join(f"WHEN {lit(u)} THEN {lit(c)}" for u, c, _ in rules.UNITS) + " ELSE 'piece' END"
_case_factor = "CASE {u} " + " ".join(f"WHEN {lit(u)} THEN {f}" for u, _, f in rules.UNITS) + " ELSE 1.0 END"


@query("ipq_extract", f"SELECT sample_id, i.value AS value, i.unit AS unit, i.confidence AS confidence, i.method AS method FROM (SELECT sample_id, {ipq_sql(C)} AS i FROM products)", "value confidence")
def ipq_extract(spark, d):
    return products(spark, d).select("sample_id", extract.pack_quantity(F.col(C)).alias("i")).select("sample_id", "i.value", "i.unit", "i.confidence", "i.method")


@query("unit_normalize", f"SELECT sample_id, value, unit, value * {_case_factor.format(u='unit')} AS normalized, {_case_unit.format(u='unit')} AS canonical FROM (SELECT sample_id, lower(trim(regexp_extract({C}, '(?i)Unit\\s*:\\s*([^\\n\\r]+)', 1))) AS unit, {num(C, r'(?i)Value\s*:\s*([0-9.]+)')} AS value FROM products)", "value normalized")
def unit_normalize(spark, d):
    unit = F.lower(F.btrim(F.regexp_extract(C, r"(?i)Unit\s*:\s*([^\n\r]+)", 1)))
    rows = products(spark, d).select("sample_id", unit.alias("unit"), extract.first_match(F.col(C), r"(?i)Value\s*:\s*([0-9.]+)").cast("double").alias("value"))
    units = spark.createDataFrame(rules.UNITS, "unit string, canonical string, factor double")  # a fixed table
    joined = rows.join(F.broadcast(units), "unit", "left")
    return joined.select("sample_id", "value", "unit", (F.col("value") * F.coalesce("factor", F.lit(1.0))).alias("normalized"), F.coalesce("canonical", F.lit("piece")).alias("canonical"))


@query(
    "quantity_features",
    f"SELECT sample_id, i IS NOT NULL AS has_ipq, coalesce(i.confidence, 0) AS confidence, coalesce(i.value, 0) AS value, coalesce({_case_unit.format(u='i.unit')} = 'gram', false) AND i IS NOT NULL AS is_weight, coalesce({_case_unit.format(u='i.unit')} = 'milliliter', false) AND i IS NOT NULL AS is_volume, i IS NOT NULL AND {_case_unit.format(u='i.unit')} = 'piece' AS is_count, ln(1 + coalesce(i.value, 0)) AS log_value, coalesce(i.value, 0) * {_case_factor.format(u='i.unit')} AS normalized, i.method AS method, i.unit AS unit FROM (SELECT sample_id, {ipq_sql(C)} AS i FROM products)",
    "confidence value log_value normalized",
)
def quantity_features(spark, d):
    rows = products(spark, d).select("sample_id", extract.pack_quantity(F.col(C)).alias("i")).withColumn("u", extract.canonical_unit(F.col("i.unit")))
    has, value = F.col("i").isNotNull(), F.coalesce("i.value", F.lit(0.0))
    kind = lambda k: has & (F.col("u.unit") == k)
    return rows.select("sample_id", has.alias("has_ipq"), F.coalesce("i.confidence", F.lit(0.0)).alias("confidence"), value.alias("value"), kind("gram").alias("is_weight"), kind("milliliter").alias("is_volume"), kind("piece").alias("is_count"), F.log1p(value).alias("log_value"), (value * F.col("u.factor")).alias("normalized"), "i.method", "i.unit")


@query(
    "ipq_precision",
    f"""WITH e AS (SELECT sample_id, CAST(p_size AS DOUBLE) AS want, CASE p_partkey % 6 WHEN 0 THEN 'gram' WHEN 1 THEN 'milliliter' WHEN 2 THEN 'gram' WHEN 3 THEN 'gram' WHEN 4 THEN 'piece' ELSE 'milliliter' END AS unit, {ipq_sql(C)} AS i FROM products JOIN part ON CAST(p_partkey AS VARCHAR) = sample_id WHERE p_partkey % 3 <> 0)
    SELECT count(*) AS cases, count(*) FILTER (abs(i.value - want) < 0.01 AND {_case_unit.format(u='i.unit')} = unit) AS correct, count(*) FILTER (abs(i.value - want) < 0.01 AND {_case_unit.format(u='i.unit')} = unit) / CAST(count(*) AS DOUBLE) AS precision FROM e""",
    "precision",
)
def ipq_precision(spark, d):
    k = F.col("p_partkey")
    unit = F.when(k % 6 == 4, "piece").when((k % 6).isin(1, 5), "milliliter").otherwise("gram")
    cases = table(spark, d, "part").filter(k % 3 != 0).select(k.cast("string").alias("sample_id"), F.col("p_size").cast("double").alias("want"), unit.alias("want_unit"))
    got = products(spark, d).select("sample_id", extract.pack_quantity(F.col(C)).alias("i"))
    ok = (F.abs(F.col("i.value") - F.col("want")) < 0.01) & (extract.canonical_unit(F.col("i.unit"))["unit"] == F.col("want_unit"))
    return got.join(cases, "sample_id").agg(F.count("*").alias("cases"), F.count_if(ok).alias("correct"), (F.count_if(ok) / F.count("*")).alias("precision"))


_parser = "CASE " + " ".join(f"WHEN regexp_matches({L}, {lit(p)}) THEN {{'value': {num(L, p)}, 'confidence': {1 - 0.1 * i:.1f}, 'method': 'pattern_{i + 1}'}}" for i, p in enumerate(rules.PARSER_IPQ)) + " END"


@query("parser_ipq", f"SELECT sample_id, i IS NOT NULL AS extracted, coalesce(i.value, 0) AS value, coalesce(i.confidence, 0) AS confidence, i.method AS method FROM (SELECT sample_id, {_parser} AS i FROM products)", "value confidence")
def parser_ipq(spark, d):
    rows = products(spark, d).select("sample_id", extract.parser_quantity(F.col(C)).alias("i"))
    return rows.select("sample_id", F.col("i").isNotNull().alias("extracted"), F.coalesce("i.value", F.lit(0.0)).alias("value"), F.coalesce("i.confidence", F.lit(0.0)).alias("confidence"), "i.method")


def _metres(p: str, i: int) -> str:
    unit = f"regexp_extract({L}, {lit(p)}, {2 * i + 2})"
    return f"({num(L, p, 2 * i + 1)} * CASE {unit} " + " ".join(f"WHEN '{u}' THEN {f}" for u, f in rules.LENGTHS) + " ELSE 1 END)"


def _dims_sql() -> str:
    has = {k: f"regexp_matches({L}, {lit(p)})" for k, p in (("lwh", rules.LWH), ("dia", rules.DIAMETER), ("lw", rules.LW))}
    a, b, c = (_metres(rules.LWH, i) for i in range(3))
    p, q = (_metres(rules.LW, i) for i in range(2))
    dia = _metres(rules.DIAMETER, 0)
    single = f"({num(L, rules.LABELLED, 2)} * CASE regexp_extract({L}, {lit(rules.LABELLED)}, 3) " + " ".join(f"WHEN '{u}' THEN {f}" for u, f in rules.LENGTHS) + " ELSE 1 END)"
    alone = f"regexp_matches({L}, {lit(rules.LABELLED)}) AND NOT ({has['lwh']} OR {has['dia']} OR {has['lw']})"
    case = lambda lwh, di, lw: f"CASE WHEN {has['lwh']} THEN {lwh} WHEN {has['dia']} THEN {di} WHEN {has['lw']} THEN {lw} END"
    return f"SELECT sample_id, {case(a, 'NULL', p)} AS length, {case(b, 'NULL', q)} AS width, {case(c, 'NULL', 'NULL')} AS height, {case(f'{a}*{b}*{c}', 'NULL', 'NULL')} AS volume, {case('NULL', f'3.14159 * ({dia} / 2) * ({dia} / 2)', f'{p}*{q}')} AS area, {case('NULL', dia, 'NULL')} AS diameter, {case('NULL', f'{dia} / 2', 'NULL')} AS radius, CASE WHEN {alone} THEN {single} END AS labelled, CASE WHEN {alone} THEN regexp_extract({L}, {lit(rules.LABELLED)}, 1) END AS labelled_as, {has['lwh']} OR {has['dia']} OR {has['lw']} AS has_dimensions FROM products"


@query("dimensions", _dims_sql(), "length width height volume area diameter radius labelled")
def dimensions(spark, d):
    return products(spark, d).select("sample_id", *(c.alias(n) for n, c in extract.dimensions(F.col(C)).items()))


def _lexicon_sql(lists) -> str:
    hits = "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all({L}, {lit(rf'\b(?:{w})\b')})" for w in lists) + "])))"
    return f"list_filter({hits}, lambda h: len(list_filter({hits}, lambda o: o <> h AND contains(o, h))) = 0)"


for _name, _lists in (("materials", rules.MATERIALS), ("colors", rules.COLORS)):

    @query(_name, f"SELECT sample_id, array_to_string({_lexicon_sql(_lists)}, ',') AS {_name}, CAST(len({_lexicon_sql(_lists)}) AS BIGINT) AS n FROM products")
    def _found(spark, d, name=_name, lists=_lists):
        hits = products(spark, d).select("sample_id", extract.lexicon(F.col(C), lists).alias("hits"))
        return hits.select("sample_id", F.array_join("hits", ",").alias(name), F.size("hits").cast("long").alias("n"))


_brand = "CASE " + " ".join(f"WHEN regexp_matches({L}, {lit(rf'\b({w})\b')}) THEN {{'brand': regexp_extract({L}, {lit(rf'\b({w})\b')}, 1), 'kind': '{k}'}}" for w, k in rules.BRANDS) + " END"
_category = "CASE " + " ".join(f"WHEN regexp_matches({L}, {lit(rf'\b(?:{w})\b')}) THEN {{'category': '{c}', 'confidence': {f}}}" for w, c, f in sorted(rules.CATEGORIES, key=lambda r: -r[2])) + " END"


@query("brand", f"SELECT sample_id, b.brand AS brand, b.kind AS brand_category, CASE WHEN b IS NULL THEN 0 ELSE 0.9 END AS brand_confidence FROM (SELECT sample_id, {_brand} AS b FROM products)", "brand_confidence")
def brand(spark, d):
    b = products(spark, d).select("sample_id", extract.brand(F.col(C)).alias("b"))
    return b.select("sample_id", "b.brand", F.col("b.kind").alias("brand_category"), F.when(F.col("b").isNull(), 0.0).otherwise(0.9).alias("brand_confidence"))


@query("category", f"SELECT sample_id, c.category AS category, coalesce(c.confidence, 0) AS confidence FROM (SELECT sample_id, {_category} AS c FROM products)", "confidence")
def category(spark, d):
    return products(spark, d).select("sample_id", extract.category(F.col(C)).alias("c")).select("sample_id", "c.category", F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"))


def _spec_sql(name: str, p: str) -> str:
    value = num(L, p)
    return f"{value} * {_case_factor.format(u=f'regexp_extract({L}, {lit(p)}, 2)')}" if name == "weight" else value


@query("specifications", "SELECT sample_id, " + ", ".join(f"{_spec_sql(n, p)} AS {n}_value" for n, p in rules.SPECS) + f", nullif(regexp_extract({L}, {lit(rules.SPECS[0][1])}, 0), '') AS weight_raw, CAST(" + " + ".join(f"CAST(regexp_matches({L}, {lit(p)}) AS INT)" for _, p in rules.SPECS) + " AS BIGINT) AS n_specs FROM products", " ".join(f"{n}_value" for n, _ in rules.SPECS))
def specifications(spark, d):
    s = products(spark, d).select("sample_id", extract.specifications(F.col(C)).alias("s"))
    at = lambda n: F.element_at("s", F.lit(n))
    return s.select("sample_id", *(at(n)["value"].alias(f"{n}_value") for n, _ in rules.SPECS), at("weight")["raw"].alias("weight_raw"), F.size("s").cast("long").alias("n_specs"))


_wide = "ipq_value ipq_confidence length width height volume area diameter radius brand_confidence category_confidence " + " ".join(f"{n}_value" for n, _ in rules.SPECS)


@query(
    "numeric_features",
    f"""WITH p AS (SELECT sample_id, {_parser} AS i, {_brand} AS b, {_category} AS c, CAST(len({_lexicon_sql(rules.MATERIALS)}) AS BIGINT) AS material_count, CAST(len({_lexicon_sql(rules.COLORS)}) AS BIGINT) AS color_count, {', '.join(f'coalesce({_spec_sql(n, q)}, 0) AS {n}_value' for n, q in rules.SPECS)} FROM products), d AS ({_dims_sql()})
    SELECT p.sample_id, i IS NOT NULL AS has_ipq, coalesce(i.value, 0) AS ipq_value, coalesce(i.confidence, 0) AS ipq_confidence, has_dimensions, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('length', 'width', 'height', 'volume', 'area', 'diameter', 'radius'))}, material_count, color_count, b IS NOT NULL AS has_brand, CASE WHEN b IS NULL THEN 0 ELSE 0.9 END AS brand_confidence, c IS NOT NULL AS has_category, coalesce(c.confidence, 0) AS category_confidence, {', '.join(f'{n}_value' for n, _ in rules.SPECS)} FROM p JOIN d USING (sample_id)""",
    _wide,
)
def numeric_features(spark, d):
    t = F.col(C)
    rows = spread_products(spark, d).select("sample_id", extract.parser_quantity(t).alias("i"), extract.brand(t).alias("b"), extract.category(t).alias("c"), extract.lexicon(t, rules.MATERIALS).alias("m"), extract.lexicon(t, rules.COLORS).alias("k"), extract.specifications(t).alias("s"), *(c.alias(n) for n, c in extract.dimensions(t).items()))
    zero = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))
    return rows.select(
        "sample_id", F.col("i").isNotNull().alias("has_ipq"), zero("i.value").alias("ipq_value"), zero("i.confidence").alias("ipq_confidence"), "has_dimensions", *(zero(x).alias(x) for x in ("length", "width", "height", "volume", "area", "diameter", "radius")),
        F.size("m").cast("long").alias("material_count"), F.size("k").cast("long").alias("color_count"), F.col("b").isNotNull().alias("has_brand"), F.when(F.col("b").isNull(), 0.0).otherwise(0.9).alias("brand_confidence"), F.col("c").isNotNull().alias("has_category"), zero("c.confidence").alias("category_confidence"),
        *(zero(F.element_at("s", F.lit(n))["value"]).alias(f"{n}_value") for n, _ in rules.SPECS),
    )


_t = "trim(coalesce(text, ''))"
_w = f"regexp_extract_all({_t}, '\\S+')"
_of = lambda p: f"len(regexp_extract_all({_t}, {lit(p)})) / CAST(greatest(length({_t}), 1) AS DOUBLE)"
_n = f"CAST(greatest(len({_w}), 1) AS DOUBLE)"
_STATS = "avg_word_length avg_sentence_length uppercase_ratio lowercase_ratio digit_ratio punctuation_ratio whitespace_ratio unique_word_ratio long_word_ratio short_word_ratio"


@query(
    "text_statistics",
    f"""SELECT doc_id, CAST(length({_t}) AS BIGINT) AS char_count, CAST(len({_w}) AS BIGINT) AS word_count, CAST(len(list_filter(regexp_split_to_array({_t}, '[.!?]+'), lambda s: regexp_replace(s, '\\s', '', 'g') <> '')) AS BIGINT) AS sentence_count,
    CASE WHEN len({_w}) > 0 THEN CAST(list_sum(list_transform({_w}, lambda w: length(w))) AS DOUBLE) / len({_w}) ELSE 0 END AS avg_word_length, len({_w}) / CAST(greatest(len(regexp_split_to_array({_t}, '[.!?]+')), 1) AS DOUBLE) AS avg_sentence_length,
    {_of(r'\p{Lu}')} AS uppercase_ratio, {_of(r'\p{Ll}')} AS lowercase_ratio, {_of('[0-9]')} AS digit_ratio, {_of(r'[!-/:-@\[-`{-~]')} AS punctuation_ratio, {_of(r'\s')} AS whitespace_ratio,
    len(list_distinct({_w})) / {_n} AS unique_word_ratio, len(list_filter({_w}, lambda w: length(w) > 6)) / {_n} AS long_word_ratio, len(list_filter({_w}, lambda w: length(w) <= 3)) / {_n} AS short_word_ratio,
    regexp_matches({_t}, '[0-9]') AS has_numbers, regexp_matches({_t}, '[!@#$%^&*()]') AS has_special_chars, regexp_matches({_t}, 'https?://|www\\.') AS has_urls, regexp_matches({_t}, {lit(rules.EMAIL)}) AS has_email FROM documents""",
    _STATS,
)
def text_statistics(spark, d):
    return text_statistics_of(table(spark, d, "documents"), "text").select("doc_id", "s.*")


def text_statistics_of(df, text):
    """``df`` with a struct ``s``. The words are a column of their own first, so they are taken apart once."""
    parted = df.withColumn("t", F.struct(*(c.alias(n) for n, c in extract.text_words(F.col(text)).items())))
    return parted.withColumn("s", F.struct(*(c.alias(n) for n, c in extract.text_statistics(F.col("t.text"), F.col("t.words")).items()))).drop("t")


_groups = "len(regexp_extract_all(w, '[aeiouy]+'))"
_READ = "flesch_reading_ease flesch_kincaid_grade automated_readability_index coleman_liau_index"


@query(
    "readability",
    f"""WITH b AS (SELECT doc_id, CAST(len(regexp_split_to_array({_t}, '[.!?]+')) AS DOUBLE) AS s, CAST(len({_w}) AS DOUBLE) AS n, CAST(length(regexp_replace({_t}, '\\s', '', 'g')) AS DOUBLE) AS c,
    CAST(greatest(coalesce(list_sum(list_transform(regexp_extract_all(lower({_t}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: greatest({_groups} - CASE WHEN w LIKE '%e' AND {_groups} > 1 THEN 1 ELSE 0 END, 1))), 0), 1) AS DOUBLE) AS y FROM documents)
    SELECT doc_id, CASE WHEN n > 0 THEN least(greatest(206.835 - 1.015 * n / s - 84.6 * y / n, 0), 100) ELSE 0 END AS flesch_reading_ease, CASE WHEN n > 0 THEN greatest(0.39 * n / s + 11.8 * y / n - 15.59, 0) ELSE 0 END AS flesch_kincaid_grade, CASE WHEN n > 0 THEN greatest(4.71 * c / n + 0.5 * n / s - 21.43, 0) ELSE 0 END AS automated_readability_index, CASE WHEN n > 0 THEN greatest(0.0588 * (c / n * 100) - 0.296 * (s / n * 100) - 15.8, 0) ELSE 0 END AS coleman_liau_index FROM b""",
    _READ,
)
def readability(spark, d):
    return readability_of(table(spark, d, "documents"), "text").select("doc_id", "r.*")


def readability_of(df, text):
    """``df`` with a struct ``r``. Counts, syllables and scores are columns one after another, so each count is made once."""
    counted = df.withColumn("c", F.struct(*(c.alias(n) for n, c in extract.readability_counts(F.col(text)).items())))
    beats = counted.withColumn("beats", extract.syllables(F.col("c.shape")))
    return beats.withColumn("r", F.struct(*(c.alias(n) for n, c in extract.readability(F.col("c.sentences"), F.col("c.words"), F.col("c.letters"), F.col("beats")).items()))).drop("c", "beats")


_cats = "[" + ", ".join(f"CASE WHEN regexp_matches({L}, {lit(rf'\b({w})\b')}) THEN '{c}' END" for w, c in rules.TEXT_CATEGORIES) + "]"
_brands = "flatten([" + ", ".join(f"list_transform(regexp_extract_all({L}, {lit(rf'\b({w})\b')}), lambda b: {{'brand': b, 'kind': '{k}'}})" for w, k in rules.TEXT_BRANDS) + "])"


@query("categorical_text", f"SELECT sample_id, array_to_string(list_transform(b, lambda x: x.brand), ',') AS brands, array_to_string(list_transform(b, lambda x: x.kind), ',') AS brand_categories, array_to_string(c, ',') AS categories, CAST(len(b) AS BIGINT) AS brand_count, CAST(len(c) AS BIGINT) AS category_count, len(b) > 0 AS has_brand, len(c) > 0 AS has_category FROM (SELECT sample_id, {_brands} AS b, list_sort(list_distinct(list_filter({_cats}, lambda x: x IS NOT NULL))) AS c FROM products)")
def categorical_text(spark, d):
    t = F.lower(F.col(C))
    found = F.array_compact(F.array(*(F.when(t.rlike(rf"\b({w})\b"), F.lit(c)) for w, c in rules.TEXT_CATEGORIES)))
    named = lambda kind: lambda b: F.struct(b.alias("brand"), F.lit(kind).alias("kind"))
    brands = F.concat(*(F.transform(F.regexp_extract_all(t, F.lit(rf"\b({w})\b"), F.lit(0)), named(k)) for w, k in rules.TEXT_BRANDS))
    rows = products(spark, d).select("sample_id", brands.alias("b"), F.array_sort(F.array_distinct(found)).alias("c"))
    return rows.select("sample_id", F.array_join("b.brand", ",").alias("brands"), F.array_join("b.kind", ",").alias("brand_categories"), F.array_join("c", ",").alias("categories"), F.size("b").cast("long").alias("brand_count"), F.size("c").cast("long").alias("category_count"), (F.size("b") > 0).alias("has_brand"), (F.size("c") > 0).alias("has_category"))


_base = "regexp_replace(regexp_extract(url, '^[^?#]*/([^/?#]*)', 1), '[^A-Za-z0-9._-]', '', 'g')"


@query("url_features", f"SELECT page_id, md5(url) AS url_hash, CASE WHEN contains({_base}, '.') THEN {_base} ELSE 'image_' || substr(md5(url), 1, 8) || '.jpg' END AS file_name, nullif(lower(regexp_extract({_base}, '[.]([A-Za-z0-9]+)$', 1)), '') AS extension FROM pages")
def url_features(spark, d):
    base = F.regexp_replace(F.regexp_extract("url", r"^[^?#]*/([^/?#]*)", 1), r"[^A-Za-z0-9._-]", "")
    name = F.when(F.contains(base, F.lit(".")), base).otherwise(F.concat(F.lit("image_"), F.substring(F.md5("url"), 1, 8), F.lit(".jpg")))
    return table(spark, d, "pages").select("page_id", F.md5("url").alias("url_hash"), name.alias("file_name"), F.nullif(F.lower(F.regexp_extract(base, r"[.]([A-Za-z0-9]+)$", 1)), F.lit("")).alias("extension"))


VOCAB, SEQUENCE = 50_000 - 2, 512
_tok = r"[\p{L}\p{N}_]+"


@query(
    "vocab_encode",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {lit(_tok)})[1:{SEQUENCE}]) AS w, unnest(range(1, least(len(regexp_extract_all(lower(text), {lit(_tok)})), {SEQUENCE}) + 1)) AS p FROM documents), a AS (SELECT unnest(regexp_extract_all(lower(text), {lit(_tok)})) AS w FROM documents),
    v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) + 1 AS id FROM a GROUP BY w QUALIFY id <= {VOCAB} + 1)
    SELECT doc_id, array_to_string(list_resize(coalesce(list(coalesce(id, 0) ORDER BY p) FILTER (p IS NOT NULL), []), {SEQUENCE}, 1), ' ') AS ids FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN v USING (w) GROUP BY doc_id""",
)
def vocab_encode(spark, d):
    """Ids from 2 for the commonest words, 0 for others, 1 to fill up to a fixed length; the vocabulary has at most VOCAB rows."""
    words = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(_tok), F.lit(0)).alias("ws"))
    top = words.select(F.explode("ws").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(VOCAB)
    ids = features.encode_words(words.select("doc_id", F.slice("ws", 1, SEQUENCE).alias("ws")), [r.w for r in top.collect()], SEQUENCE)
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("vocab_topn", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {lit(_tok)})) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 50")
def vocab_topn(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_tok), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query("target_transform", "SELECT sample_id, model, ln(1 + y_true) AS log_price, exp(least(greatest(ln(1 + y_pred), 0), 15)) - 1 AS price_back FROM predictions", "log_price price_back", 9)
def target_transform(spark, d):
    return predictions(spark, d).select("sample_id", "model", F.log1p("y_true").alias("log_price"), F.expm1(F.least(F.greatest(F.log1p("y_pred"), F.lit(0.0)), F.lit(15.0))).alias("price_back"))


@query("fallback_route", f"SELECT sample_id, CASE WHEN CAST('0x' || substr(md5({C}), 1, 2) AS BIGINT) % 2 = 1 THEN 'gradient' ELSE 'default' END AS fallback FROM products")
def fallback_route(spark, d):
    odd = F.conv(F.substring(F.md5(C), 1, 2), 16, 10).cast("long") % 2 == 1
    return products(spark, d).select("sample_id", F.when(odd, "gradient").otherwise("default").alias("fallback"))


_hits = "list_filter([" + ", ".join(f"{{'name': '{n}', 'rgb': [{r}, {g}, {b}]}}" for n, r, g, b in rules.COLOR_RGB) + f"], lambda c: contains({L}, c.name))"


@query(
    "text_color_hist",
    f"""WITH h AS (SELECT sample_id, {_hits} AS hits FROM products), bins AS (SELECT sample_id, ch, CAST(floor(CAST(c.rgb[ch + 1] AS DOUBLE) * 63) AS BIGINT) AS bin, 1.0 / len(hits) AS w FROM h, unnest(hits) AS u(c), unnest([0, 1, 2]) AS k(ch)),
    neutral AS (SELECT sample_id, ch, CAST(32 AS BIGINT) AS bin, 0.3 AS w FROM h, unnest([0, 1, 2]) AS k(ch) WHERE len(hits) = 0), a AS (SELECT * FROM bins UNION ALL SELECT * FROM neutral)
    SELECT sample_id, CAST(ch * 64 + bin AS BIGINT) AS position, sum(w) / sum(sum(w)) OVER (PARTITION BY sample_id) AS share FROM a GROUP BY sample_id, ch, bin""",
    "share",
)
def text_color_hist(spark, d):
    """The non-zero bins of the 3 x 64 colour histogram of colour words (or a neutral one)."""
    rows = products(spark, d).select("sample_id", colour_hits(F.col(C)).alias("hits"))
    bins = rows.select("sample_id", colour_bins(F.col("hits")).alias("bins"))
    each = bins.select("sample_id", F.size("bins").alias("of"), F.explode("bins").alias("position"))
    return each.groupBy("sample_id", F.col("position").cast("long").alias("position")).agg((F.count("*") / F.first("of")).alias("share"))


def colour_hits(text):
    t = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(t, F.lit(n)), F.array(F.lit(r), F.lit(g), F.lit(b))) for n, r, g, b in rules.COLOR_RGB)))


def colour_bins(hits):
    """Position of every colour component among 3 x 64 bins; the middle bins without a colour."""
    return F.when(F.size(hits) > 0, F.flatten(F.transform(hits, lambda c: F.transform(c, lambda x, ch: ch * 64 + F.floor(x * 63).cast("int"))))).otherwise(F.array(F.lit(32), F.lit(96), F.lit(160)))


@query("text_dominant_colors", f"SELECT sample_id, array_to_string(list_transform(flatten(list_transform(list_concat({_hits}[1:5], list_transform(range(0, 5), lambda i: {{'name': '', 'rgb': [0.5, 0.5, 0.5]}}))[1:5], lambda c: c.rgb)), lambda x: CAST(CAST(round(x * 10) AS INT) AS VARCHAR)), ' ') AS tenths FROM products")
def text_dominant_colors(spark, d):
    """Up to five colours named in the text as RGB in tenths, filled up with grey."""
    five = F.slice(F.concat(colour_hits(F.col(C)), F.array_repeat(F.array(*[F.lit(0.5)] * 3), 5)), 1, 5)
    return products(spark, d).select("sample_id", F.array_join(F.transform(F.flatten(five), lambda x: F.round(x * 10).cast("int").cast("string")), " ").alias("tenths"))


_chars, _words = f"CAST(length({C}) AS DOUBLE)", f"CAST(len(regexp_extract_all({C}, '\\S+')) AS DOUBLE)"
_uniq = f"CAST(len(list_distinct(regexp_extract_all({L}, '\\S+'))) AS DOUBLE)"
_marks = lambda c: f"(length({C}) - length(replace({C}, {c}, '')))"
_struct = {
    "complexity": f"least(1, {_chars} / 1000)", "diversity": f"CASE WHEN {_words} > 0 THEN {_uniq} / {_words} ELSE 0 END", "word_length": f"CASE WHEN {_words} > 0 THEN least(1, length(regexp_replace({C}, '\\s', '', 'g')) / {_words} / 10) ELSE 0 END",
    "commas": f"least(1, {_marks(lit(','))} / 10.0)", "spaces": f"least(1, {_marks(lit(' '))} / 100.0)", "sentences": f"least(1, {_marks(lit('.'))} / 5.0)", "line_breaks": f"least(1, {_marks('chr(10)')} / 3.0)",
    "extent": f"least(1, {_words} / 50)", "eccentricity": f"CASE WHEN {_words} > 0 THEN least(1, {_chars} / ({_words} * 10)) ELSE 0 END", "convexity": f"CASE WHEN {_chars} > 0 THEN least(1, {_marks(lit(' '))} / {_chars}) ELSE 0 END",
}


@query("text_structure_vec", "SELECT sample_id, " + ", ".join(f"{v} AS {k}" for k, v in _struct.items()) + " FROM products", " ".join(_struct))
def text_structure_vec(spark, d):
    rows = products(spark, d).select("sample_id", *(c.alias(n) for n, c in structure(F.col(C)).items()))
    return rows


#: What the surrogate vectors hold, in order, and how long they are; the rest is zero.
STRUCTURE = {"texture": (["complexity", "diversity", "word_length", "commas", "spaces"], 13), "edge": (["sentences", "line_breaks", "complexity", "diversity"], 4), "shape": (["complexity", "diversity", "word_length", "extent", "diversity", "eccentricity", "convexity"], 7)}
_padded = " UNION ALL ".join(f"SELECT sample_id, '{k}' AS feature, unnest(range({n})) AS place, unnest([{', '.join(f'CAST({_struct[c]} AS DOUBLE)' for c in names)}{', 0' * (n - len(names))}]) AS value FROM products" for k, (names, n) in STRUCTURE.items())


@query("text_structure_padded", f"SELECT sample_id, feature, CAST(place AS INT) AS place, value FROM ({_padded})", "value")
def text_structure_padded(spark, d):
    """The texture (13), edge (4) and shape (7) vectors, a row per component."""
    rows = spread_products(spark, d).select("sample_id", F.struct(*(c.cast("double").alias(n) for n, c in structure(F.col(C)).items())).alias("s"))
    vectors = F.array(*(F.struct(F.lit(k).alias("feature"), F.array(*(F.col(f"s.{c}") for c in names), *[F.lit(0.0)] * (n - len(names))).alias("v")) for k, (names, n) in STRUCTURE.items()))
    return rows.select("sample_id", F.explode(vectors).alias("f")).select("sample_id", "f.feature", F.posexplode("f.v").alias("place", "value"))


def structure(text) -> dict:
    """Scores behind the texture (complexity .. spaces), edge and shape surrogates."""
    chars, words = F.length(text).cast("double"), F.regexp_count(text, F.lit(r"\S+")).cast("double")
    unique = F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)))).cast("double")
    marks = lambda c: chars - F.length(F.replace(text, F.lit(c), F.lit("")))
    one = lambda c: F.least(F.lit(1.0), c)
    some = lambda c: F.when(words > 0, c).otherwise(0.0)
    return {
        "complexity": one(chars / 1000), "diversity": some(unique / words), "word_length": some(one(F.length(F.regexp_replace(text, r"\s", "")) / words / 10)),
        "commas": one(marks(",") / 10), "spaces": one(marks(" ") / 100), "sentences": one(marks(".") / 5), "line_breaks": one(marks("\n") / 3),
        "extent": one(words / 50), "eccentricity": some(one(chars / (words * 10))), "convexity": F.when(chars > 0, one(marks(" ") / chars)).otherwise(0.0),
    }
