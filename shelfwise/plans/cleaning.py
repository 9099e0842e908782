"""Queries over projections, filters and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import clean, rules
from shelfwise.plans.registry import lit, query
from shelfwise.sources.tables import products, spread_products, submission, table

WS = r"\s+"


def _replaces(text: str, pairs) -> str:
    for a, b in pairs:
        text = f"replace({text}, {lit(a)}, {lit(b)})"
    return text


def _regexes(text: str, pairs) -> str:
    for a, b in pairs:
        text = f"regexp_replace({text}, {lit(a)}, {lit(b.replace('$1', chr(92) + '1'))}, 'g')"
    return text


def price_sql(text: str) -> str:
    bare = _regexes(text, [(rules.CURRENCY, ""), *[(r",(\d{3})(\D|$)", r"\1\2")] * 3, (r"[\s']", "")])
    return f"CASE WHEN regexp_matches({bare}, {lit(rules.NUMBER)}) THEN TRY_CAST({bare} AS DOUBLE) END"


STEPS = [("html", rules.HTML_TAG, " "), ("url", rules.URL, " [URL] "), ("email", rules.EMAIL, " [EMAIL] "), ("phone", rules.PHONE, " [PHONE] ")]


def clean_sql(text: str) -> str:
    text = _replaces(_regexes(text, [(p, to) for _, p, to in STEPS]), rules.SPECIAL)
    text = f"trim({_regexes(text, [(WS, ' ')])})"
    text = _regexes(text, [(r"[!]{2,}", "!"), (r"[?]{2,}", "?"), (r"[.]{3,}", "..."), (r"\s*:\s*", ": "), (r"\s*,\s*", ", "), (r"\s*;\s*", "; ")])
    return f"trim({text}, ' .,;:-')"


_MARKS = r"""[^\p{L}\p{N}_\s\-.,()&/'"]"""


def clean_text_sql(text: str) -> str:
    text = _replaces(_regexes(f"coalesce({text}, '')", [(rules.HTML_TAG, " ")]), rules.ENTITIES)
    return f"trim({_regexes(text, [(_MARKS, ' '), (WS, ' ')])})"


def standardize_sql(text: str) -> str:
    return _regexes(f"lower({clean_text_sql(text)})", rules.TERMS)


@query("price_normalize", f"SELECT sample_id, price_text, {price_sql('price_text')} AS price FROM products", "price")
def price_normalize(spark, d):
    return products(spark, d).select("sample_id", "price_text", clean.price_from_text(F.col("price_text")).alias("price"))


def _price_report_sql() -> str:
    """The same steps as nested replacements, a SELECT for each."""
    now, parts = "price_text", []

    def step(kind: str, name: str, hit: str, then: str) -> str:
        parts.append(f"SELECT '{kind}' AS kind, {lit(name)} AS pattern, {now} AS text FROM products WHERE {hit}")
        return then

    for mark in rules.CURRENCY_MARKS:
        now = step("currency", mark, f"contains({now}, {lit(mark)})", f"replace({now}, {lit(mark)}, '')")
    comma = r",(\d{3})(\D|$)"
    now = step("separator", ",", f"regexp_matches({now}, {lit(comma)})", _regexes(now, [(comma, r"\1\2")] * 3))
    now = step("separator", "space", rf"regexp_matches({now}, '\s')", rf"regexp_replace({now}, '\s', '', 'g')")
    step("separator", "'", f"contains({now}, chr(39))", now)
    parts.append(f"SELECT 'invalid' AS kind, '' AS pattern, price_text AS text FROM products WHERE price_text IS NOT NULL AND {price_sql('price_text')} IS NULL")
    return f"WITH f AS ({' UNION ALL '.join(parts)}), g AS (SELECT *, row_number() OVER (PARTITION BY kind, pattern ORDER BY text) AS r FROM (SELECT kind, pattern, text, count(*) AS n FROM f GROUP BY ALL)) SELECT kind, pattern, CAST(sum(n) AS BIGINT) AS count, string_agg(text, ' | ' ORDER BY text) FILTER (r <= CASE WHEN kind = 'invalid' THEN 10 ELSE 5 END) AS samples FROM g GROUP BY kind, pattern"


@query("price_normalize_report", _price_report_sql())
def price_normalize_report(spark, d):
    """Prices that each rule changes, and those that are none, with samples."""
    return clean.price_report(products(spark, d), "price_text")


@query(
    "zero_price",
    "SELECT sample_id, price, CASE WHEN coalesce(price, 0) = 0 THEN 0.01 ELSE price END AS epsilon_price, coalesce(price, 0) = 0 AS is_zero_price, coalesce(price, 0) <> 0 AS kept_by_drop FROM products",
    "price epsilon_price",
)
def zero_price(spark, d):
    zero = F.coalesce("price", F.lit(0.0)) == 0
    return products(spark, d).select("sample_id", "price", F.when(zero, F.lit(0.01)).otherwise(F.col("price")).alias("epsilon_price"), zero.alias("is_zero_price"), (~zero).alias("kept_by_drop"))


@query("price_range_validate", "SELECT count(*) FILTER (price < 0.01) AS below_min, count(*) FILTER (price > 10000) AS above_max, count(*) FILTER (price < 0) AS negative, count(price) > 0 AS has_prices, count(price) > 0 AND count(*) FILTER (price < 0.01 OR price > 10000) = 0 AS valid FROM submission")
def price_range_validate(spark, d):
    p = F.col("price")
    return submission(spark, d).agg(
        F.count_if(p < 0.01).alias("below_min"), F.count_if(p > 10000).alias("above_max"), F.count_if(p < 0).alias("negative"), (F.count(p) > 0).alias("has_prices"), ((F.count(p) > 0) & (F.count_if((p < 0.01) | (p > 10000)) == 0)).alias("valid")
    )


@query("clean_catalog", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_catalog(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.clean_catalog(F.col("text")).alias("cleaned"))


def _stats_sql() -> str:
    text, counts = "text", []
    for name, p, to in STEPS:
        counts.append(f"count(*) FILTER (regexp_matches({text}, {lit(p)})) AS {name}")
        text = _regexes(text, [(p, to)])
    any_special = " OR ".join(f"contains({text}, {lit(a)})" for a, _ in rules.SPECIAL)
    spaced = _replaces(text, rules.SPECIAL)
    counts += [f"count(*) FILTER ({any_special}) AS special", f"count(*) FILTER (length(trim({_regexes(spaced, [(WS, ' ')])})) <> length({spaced})) AS space", "count(*) AS rows"]
    return f"WITH c AS (SELECT {', '.join(counts)} FROM documents) SELECT *, CASE WHEN rows > 0 THEN 100.0 * html / rows ELSE 0 END AS html_rate, CASE WHEN rows > 0 THEN 100.0 * (url + email + phone) / rows ELSE 0 END AS contact_rate, url + email + phone > rows / 10 AS many_contacts FROM c"


@query("clean_stats", _stats_sql(), "html_rate contact_rate")
def clean_stats(spark, d):
    s = clean.cleaning_steps(F.col("text"))
    special = F.lit(False)
    for a, _ in rules.SPECIAL:
        special = special | F.contains(s["special"], F.lit(a))
    tests = {name: s[name].rlike(p) for name, p, _ in STEPS} | {"special": special, "space": F.length(F.btrim(F.regexp_replace(s["space"], WS, " "))) != F.length(s["space"])}
    c = table(spark, d, "documents").agg(*(F.count_if(t).alias(n) for n, t in tests.items()), F.count("*").alias("rows"))
    contacts = F.col("url") + F.col("email") + F.col("phone")
    rate = lambda x: F.when(F.col("rows") > 0, 100.0 * x / F.col("rows")).otherwise(0.0)
    return c.select("*", rate(F.col("html")).alias("html_rate"), rate(contacts).alias("contact_rate"), (contacts > F.col("rows") / 10).alias("many_contacts"))


@query("missing_values", f"SELECT sample_id, coalesce(catalog_content, {lit(rules.NO_DESCRIPTION)}) AS catalog_content, coalesce(image_link, {lit(rules.NO_IMAGE)}) AS image_link, image_link IS NOT NULL AS has_image FROM products")
def missing_values(spark, d):
    return products(spark, d).select("sample_id", F.coalesce("catalog_content", F.lit(rules.NO_DESCRIPTION)).alias("catalog_content"), F.coalesce("image_link", F.lit(rules.NO_IMAGE)).alias("image_link"), F.col("image_link").isNotNull().alias("has_image"))


_units = _regexes("catalog_content", [*rules.LABELS, *((rf"(?i)\b{a}\b", b) for a, b in rules.MEASURES), (r"(?i)\bpack\s+of\s+(\d+)\b", "($1-pack)"), (r"(?i)\b(\d+)\s*-?\s*pack\b", "($1-pack)"), (WS, " ")])


@query("standardize_units_text", f"SELECT sample_id, trim({_units}) AS standardized FROM products")
def standardize_units_text(spark, d):
    return products(spark, d).select("sample_id", clean.standardize_units(F.col("catalog_content")).alias("standardized"))


_name, _value, _unit, _bullet = (rf"(?i){p}\s*:\s*([^\n\r]+)" for p in (r"Item\s+Name", "Value", "Unit", r"Bullet\s+Point\s+\d+"))


@query(
    "structured_fields",
    f"""SELECT sample_id, coalesce(trim(nullif(regexp_extract(catalog_content, {lit(_name)}, 1), '')), CASE WHEN length(trim(split_part(catalog_content, chr(10), 1))) > 10 THEN trim(split_part(catalog_content, chr(10), 1)) END) AS item_name,
    TRY_CAST(trim(regexp_extract(catalog_content, {lit(_value)}, 1)) AS DOUBLE) AS extracted_value, nullif(trim(regexp_extract(catalog_content, {lit(_unit)}, 1)), '') AS extracted_unit,
    array_to_string(list_transform(regexp_extract_all(catalog_content, {lit(_bullet)}, 1), lambda x: trim(x)), '|') AS bullet_points, CAST(len(regexp_extract_all(catalog_content, {lit(_bullet)}, 1)) AS BIGINT) AS bullet_point_count FROM products""",
    "extracted_value",
)
def structured_fields(spark, d):
    text = F.col("catalog_content")
    first = F.btrim(F.get(F.split(text, "\n"), F.lit(0)))
    points = F.regexp_extract_all(text, F.lit(_bullet), F.lit(1))
    return products(spark, d).select(
        "sample_id",
        F.coalesce(F.btrim(F.nullif(F.regexp_extract(text, _name, 1), F.lit(""))), F.when(F.length(first) > 10, first)).alias("item_name"),
        F.btrim(F.regexp_extract(text, _value, 1)).try_cast("double").alias("extracted_value"),
        F.nullif(F.btrim(F.regexp_extract(text, _unit, 1)), F.lit("")).alias("extracted_unit"),
        F.array_join(F.transform(points, lambda x: F.btrim(x)), "|").alias("bullet_points"),
        F.size(points).cast("long").alias("bullet_point_count"),
    )


@query(
    "sample_id_validate",
    "SELECT count(*) FILTER (sample_id IS NULL) AS null_ids, count(*) FILTER (trim(sample_id) = '') AS empty_ids, count(sample_id) - count(DISTINCT sample_id) AS duplicate_rows, count(*) FILTER (NOT regexp_matches(sample_id, '^[a-zA-Z0-9_-]+$')) AS bad_format, count(*) FILTER (sample_id IS NULL OR trim(sample_id) = '') = 0 AND count(sample_id) = count(DISTINCT sample_id) AS valid FROM submission",
)
def sample_id_validate(spark, d):
    i = F.col("sample_id")
    per = submission(spark, d).groupBy("sample_id").agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum(F.when(i.isNull(), F.col("n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(F.btrim(i) == "", F.col("n"))), F.lit(0)).alias("empty_ids"),
        F.coalesce(F.sum(F.when(i.isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(~i.rlike("^[a-zA-Z0-9_-]+$"), F.col("n"))), F.lit(0)).alias("bad_format"),
        ((F.count_if(i.isNull() | (F.btrim(i) == "")) == 0) & (F.coalesce(F.max("n"), F.lit(1)) <= 1)).alias("valid"),
    )


@query("cleaned_quality", f"SELECT count(*) AS rows, count(*) FILTER (c = '') AS empty, count(*) FILTER (length(c) < 20) AS short, count(*) FILTER (length(c) < 20) > count(*) / 10 AS warn FROM (SELECT {clean_sql('text')} AS c FROM documents)")
def cleaned_quality(spark, d):
    c = table(spark, d, "documents").select(F.length(clean.clean_catalog(F.col("text"))).alias("n"))
    return c.agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(F.col("n") < 20).alias("short"), (F.count_if(F.col("n") < 20) > F.count("*") / 10).alias("warn"))


@query("clean_text", f"SELECT doc_id, {clean_text_sql('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.clean_text(F.col("text")).alias("cleaned"))


@query("standardize_text", f"SELECT sample_id, {standardize_sql('catalog_content')} AS standardized FROM products")
def standardize_text(spark, d):
    return products(spark, d).select("sample_id", clean.standardize_text(F.col("catalog_content")).alias("standardized"))


def _title_sql(t: str) -> str:
    parts = [f"trim(regexp_extract({t}, {lit(p)}, 1))" for p in (r"^([^|]+)\|", r"^([^-]+)-", r"^([^\n]+)")]
    return "CASE " + " ".join(f"WHEN length({p}) > 3 THEN {clean_text_sql(p)}" for p in parts) + f" WHEN length({t}) > 10 THEN {clean_text_sql(f'{t}[1:100]')} END"


def _description_sql(t: str) -> str:
    parts = [f"trim(regexp_extract({t}, {lit(p)}, 1))" for p in (r"\|([^|]+)$", r"-([^-]+)$", r"(?s)^[^|]*\|(.*)$", r"(?s)^[^-]*-(.*)$", r"(?s)^[^\n]*\n(.*)$")]
    return "CASE " + " ".join(f"WHEN length({p}) > 10 THEN {clean_text_sql(p)}" for p in parts) + f" WHEN length({t}) > 10 THEN {clean_text_sql(t)} END"


def _quantity_sql(t: str) -> str:
    parts = [f"trim(regexp_extract({t}, {lit(p)}, 1))" for p in (r"(?i)(?:pack|quantity|qty|count|size)\s*:?\s*([^|,\n]+)", r"(?i)(\d+\s*(?:pack|pcs?|pieces?|count|units?))", r"(?i)(pack\s+of\s+\d+)", r"(?i)(\d+\s*x\s*\d+)")]
    return "CASE " + " ".join(f"WHEN {p} <> '' THEN {clean_text_sql(p)}" for p in parts) + " END"


_T = "trim(catalog_content)"


@query("parse_title_desc", f"SELECT sample_id, {_title_sql(_T)} AS title, {_description_sql(_T)} AS description FROM products")
def parse_title_desc(spark, d):
    t = F.col("catalog_content")
    return products(spark, d).select("sample_id", clean.title_of(t).alias("title"), clean.description_of(t).alias("description"))


@query(
    "product_attributes",
    f"WITH a AS (SELECT sample_id, {_title_sql(_T)} AS title, {_description_sql(_T)} AS description, {_quantity_sql(_T)} AS quantity, {clean_text_sql('catalog_content')} AS cleaned, {standardize_sql('catalog_content')} AS standardized, CAST(length(catalog_content) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(catalog_content, '\\S+')) AS BIGINT) AS n_words FROM products) SELECT *, title IS NOT NULL AS has_title, description IS NOT NULL AS has_description, quantity IS NOT NULL AS has_quantity FROM a",
)
def product_attributes(spark, d):
    t = F.col("catalog_content")
    a = spread_products(spark, d).select(
        "sample_id", clean.title_of(t).alias("title"), clean.description_of(t).alias("description"), clean.quantity_text(F.btrim(t)).alias("quantity"), clean.clean_text(t).alias("cleaned"), clean.standardize_text(t).alias("standardized"), F.length(t).cast("long").alias("n_chars"), F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("n_words")
    )
    return a.select("*", *(F.col(c).isNotNull().alias(f"has_{c}") for c in ("title", "description", "quantity")))


@query("clamp_predictions", "SELECT sample_id, greatest(price, 0.01) AS price, price < 0.01 AS clamped FROM submission")
def clamp_predictions(spark, d):
    return submission(spark, d).select("sample_id", F.greatest("price", F.lit(0.01)).alias("price"), (F.col("price") < 0.01).alias("clamped"))


@query("clamp_summary", "SELECT count(*) AS rows, count(*) FILTER (price < 0.01) AS clamped, CASE WHEN count(*) > 0 THEN count(*) FILTER (price < 0.01) / CAST(count(*) AS DOUBLE) ELSE 0 END AS ratio FROM submission", "ratio")
def clamp_summary(spark, d):
    n, bad = F.count("*"), F.count_if(F.col("price") < 0.01)
    return submission(spark, d).agg(n.alias("rows"), bad.alias("clamped"), F.when(n > 0, bad / n).otherwise(0.0).alias("ratio"))


@query("format_output", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, round_even(greatest(price, 0.01), 6) AS price FROM submission")
def format_output(spark, d):
    return submission(spark, d).select(F.col("sample_id").cast("string").alias("sample_id"), (F.rint(F.greatest("price", F.lit(0.01)) * 1e6) / 1e6).alias("price"))


@query("vector_validate", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings")
def vector_validate(spark, d):
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, d, "embeddings").select("vec_id", ((F.size("embedding") == 64) & ~bad).alias("valid"))
