"""Price and text cleaning as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import rules


def price_from_text(text: Column) -> Column:
    """Currency marks, thousands commas, spaces and apostrophes go; what is no number then is null."""
    bare = F.regexp_replace(text, rules.CURRENCY, "")
    bare = F.regexp_replace(bare, r",(?=\d{3}(?:\D|$))", "")
    bare = F.regexp_replace(bare, r"[\s']", "")
    return F.when(bare.rlike(rules.NUMBER), bare.try_cast("double"))


def price_steps(text: Column) -> list[tuple[str, str, Column, Column]]:
    """Kind and name of each rule of ``price_from_text`` in order, whether it finds anything, and the text it is given."""
    steps, now = [], text
    rest = [("separator", ",", r",(?=\d{3}(?:\D|$))"), ("separator", "space", r"\s"), ("separator", "'", "'")]
    for kind, name, pattern in [*(("currency", m, re.escape(m)) for m in rules.CURRENCY_MARKS), *rest]:
        steps.append((kind, name, now.rlike(pattern), now))
        now = F.regexp_replace(now, pattern, "")
    price = price_from_text(text)
    return [*steps, ("invalid", "", text.isNotNull() & price.isNull(), text)]


def price_report(rows: DataFrame, column: str, samples: int = 5, invalid: int = 10) -> DataFrame:
    """kind, pattern, count and samples: how many price texts each rule changes, how many are no price, and the least few
    different texts of each. Rules that find nothing have no row."""
    found = F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(k).alias("kind"), F.lit(n).alias("pattern"), t.alias("text"))) for k, n, hit, t in price_steps(F.col(column)))))
    each = rows.select(F.explode(found).alias("f")).select("f.*").groupBy("kind", "pattern", "text").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind", "pattern").orderBy("text")
    most = F.when(F.col("kind") == "invalid", invalid).otherwise(samples)
    least = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(samples, invalid)).filter(F.col("r") <= most)
    kept = least.groupBy("kind", "pattern").agg(F.array_join(F.array_sort(F.collect_list("text")), " | ").alias("samples"))  # a few each
    return each.groupBy("kind", "pattern").agg(F.sum("n").alias("count")).join(kept, ["kind", "pattern"])


def replace_all(text: Column, pairs) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, *p) if p[0].startswith(("(", "\\")) else F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def cleaning_steps(text: Column) -> dict[str, Column]:
    """The text before each counted rule, and the result: html, url, email, phone, special, space, done."""
    steps = {"html": text}
    steps["url"] = F.regexp_replace(text, rules.HTML_TAG, " ")
    steps["email"] = F.regexp_replace(steps["url"], rules.URL, " [URL] ")
    steps["phone"] = F.regexp_replace(steps["email"], rules.EMAIL, " [EMAIL] ")
    steps["special"] = F.regexp_replace(steps["phone"], rules.PHONE, " [PHONE] ")
    steps["space"] = replace_all(steps["special"], rules.SPECIAL)
    c = F.btrim(F.regexp_replace(steps["space"], r"\s+", " "))
    for pattern, to in ((r"[!]{2,}", "!"), (r"[?]{2,}", "?"), (r"[.]{3,}", "..."), (r"\s*:\s*", ": "), (r"\s*,\s*", ", "), (r"\s*;\s*", "; ")):
        c = F.regexp_replace(c, pattern, to)
    steps["done"] = F.btrim(c, F.lit(" .,;:-"))
    return steps


def clean_catalog(text: Column) -> Column:
    return cleaning_steps(text)["done"]


def standardize_units(text: Column) -> Column:
    for pattern, to in rules.LABELS:
        text = F.regexp_replace(text, pattern, to)
    for short, long in rules.MEASURES:
        text = F.regexp_replace(text, rf"(?i)\b{short}\b", long)
    text = F.regexp_replace(text, r"(?i)\bpack\s+of\s+(\d+)\b", "($1-pack)")
    text = F.regexp_replace(text, r"(?i)\b(\d+)\s*-?\s*pack\b", "($1-pack)")
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Tags go, five entities are decoded, marks other than - . , ( ) & / ' and the double quote become spaces."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), rules.HTML_TAG, " ")
    text = replace_all(text, rules.ENTITIES)
    text = F.regexp_replace(text, r"""[^\p{L}\p{N}_\s\-.,()&/'"]""", " ")
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def standardize_text(text: Column) -> Column:
    text = F.lower(clean_text(text))
    for pattern, to in rules.TERMS:
        text = F.regexp_replace(text, pattern, to)
    return text


def title_of(text: Column) -> Column:
    """Before the first pipe, else the first dash, else the first line (more than 3 characters), else 100 characters."""
    text = F.btrim(text)
    parts = [F.btrim(F.regexp_extract(text, p, 1)) for p in (r"^([^|]+)\|", r"^([^-]+)-", r"^([^\n]+)")]
    return F.coalesce(*(F.when(F.length(p) > 3, clean_text(p)) for p in parts), F.when(F.length(text) > 10, clean_text(F.substring(text, 1, 100))))


def description_of(text: Column) -> Column:
    """After the last pipe or dash (more than 10 characters), else what follows the first separator, else all."""
    text = F.btrim(text)
    tails = [F.btrim(F.regexp_extract(text, p, 1)) for p in (r"\|([^|]+)$", r"-([^-]+)$")]
    rest = [F.btrim(F.regexp_extract(text, p, 1)) for p in (r"(?s)^[^|]*\|(.*)$", r"(?s)^[^-]*-(.*)$", r"(?s)^[^\n]*\n(.*)$")]
    return F.coalesce(*(F.when(F.length(p) > 10, clean_text(p)) for p in [*tails, *rest]), F.when(F.length(text) > 10, clean_text(text)))


def quantity_text(text: Column) -> Column:
    found = [F.btrim(F.regexp_extract(text, p, 1)) for p in (r"(?i)(?:pack|quantity|qty|count|size)\s*:?\s*([^|,\n]+)", r"(?i)(\d+\s*(?:pack|pcs?|pieces?|count|units?))", r"(?i)(pack\s+of\s+\d+)", r"(?i)(\d+\s*x\s*\d+)")]
    return F.coalesce(*(F.when(p != "", clean_text(p)) for p in found))
