"""Language identification by fusing evidence in Bayes' rule.

log p(language | page) = text + log p(declared | language) + log p(suffix | language) + log prior(language | host)

text: mean byte-trigram log-likelihood times ``TEXT_WEIGHT`` and at most ``TEXT_BYTES`` (neighbouring trigrams are not
independent). declared: the markup's lang attribute; suffix: last part of the host name. Their likelihoods, and the host
prior, come from counts of what the text alone says over all pages; the prior is smoothed from host to domain to all,
each level adding ``SMOOTH`` pseudo-counts of the level above. A page's own vote is taken out of its host's counts.

Every label that occurs is a class; the trigram model is fitted on at most ``TRAIN_ROWS`` different labelled texts of each,
least hash of the text first. One more class, ``UNKNOWN``, holds text in which neighbouring bytes say nothing about each
other by what these languages are like. All counts and priors are over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.repeats import with_key
from shelfwise.llm.session import materialize, ship
from shelfwise.llm.text import lowered, pieces, slices

TRAIN_ROWS = 400
SLOTS = 1 << 16
TEXT_WEIGHT, TEXT_BYTES = 0.5, 400
SMOOTH = 10.0
LEAST_CONFIDENCE = 0.5
#: The class of text that is in none of the labelled languages.
UNKNOWN = "und"
#: Nats a trigram by which text has to be better described without any language: mixed languages and names stay known.
UNKNOWN_MARGIN = 1.5


def folded() -> np.ndarray:
    """ASCII letters lower-cased, all other ASCII as spaces."""
    table = lowered()
    for b in range(0x80):
        if not 0x61 <= table[b] <= 0x7A:
            table[b] = 0x20
    return table


def slot_of(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    one, two, three = (x.astype(np.uint32) for x in (one, two, three))
    return ((one * np.uint32(0x9E3779B1)) ^ (two * np.uint32(0x85EBCA6B)) ^ (three * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(16)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Slot of the byte trigram that starts at each position of the folded text."""
    d = folded()[data]
    return slot_of(d[:-2], d[1:-1], d[2:]) if len(d) > 2 else np.empty(0, np.uint32)


def letters(data: np.ndarray) -> np.ndarray:
    d = lowered()[data]
    return ((d >= 0x61) & (d <= 0x7A)) | (d >= 0x80)


def background(counts: np.ndarray) -> np.ndarray:
    """Probability of each slot where neighbouring bytes have nothing to do with each other: half the product of the byte
    shares of ``counts`` (a number for each folded byte), half the same for all slots."""
    table = folded()
    alphabet = np.unique(table)
    share = np.bincount(table, counts, minlength=256)[alphabet] + 1.0
    share /= share.sum()
    k = len(alphabet)
    one, two, three = (x.ravel() for x in np.meshgrid(range(k), range(k), range(k), indexing="ij"))
    slots = slot_of(alphabet[one], alphabet[two], alphabet[three])
    return 0.5 * np.bincount(slots, share[one] * share[two] * share[three], minlength=SLOTS) + 0.5 / SLOTS


def sample(labelled: DataFrame) -> DataFrame:
    """(text, lang, ...) -> text and lang of at most ``TRAIN_ROWS`` different texts of each label, least hash of the text
    first, whatever their ids, and once each however often they are repeated."""
    known = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null").withColumn("mark", F.xxhash64("text"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n"))  # one row per language
    # hashes are uniform: those under 4 TRAIN_ROWS / n are about 4 TRAIN_ROWS of n texts, so few have to be ranked
    share = F.shiftrightunsigned("mark", 11) / float(1 << 53)
    low = known.select("lang", "mark", share.alias("share")).join(F.broadcast(sizes), "lang").filter(F.col("share") * F.col("n") < 4 * TRAIN_ROWS).select("lang", "mark", "share").distinct()
    order = Window.partitionBy("lang").orderBy("share", "mark")
    picked = low.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TRAIN_ROWS).select("lang", "mark")
    return known.join(F.broadcast(picked), ["lang", "mark"], "left_semi").groupBy("lang", "mark").agg(F.any_value("text").alias("text")).select("text", "lang")


def fit(labelled: DataFrame):
    """(text, lang, ...) -> (language names in order and ``UNKNOWN``, table of log-likelihoods: slot x class). What reaches
    the driver is ``sample``. Without labels there are no classes."""
    picked = sample(labelled).toArrow()  # TRAIN_ROWS a language
    names = sorted(set(picked.column("lang").to_pylist()))
    if not names:
        return names, np.zeros((SLOTS, 1), np.float32)
    counts, seen = np.zeros((SLOTS, len(names))), np.zeros(256)
    tags = np.array(picked.column("lang").to_pylist(), object)
    for piece in pieces(picked.column("text").combine_chunks()):
        seen += np.bincount(piece.data, minlength=256)
        for i, row in enumerate(piece.rows):
            slots = trigrams(piece.data[piece.bounds[i] : piece.bounds[i + 1]])
            counts[:, names.index(tags[row])] += np.bincount(slots, minlength=SLOTS)
    # Witten-Bell: what is unseen has as much weight as there are different slots in the language, evenly dealt
    counts += np.maximum((counts > 0).sum(axis=0), 1) / SLOTS
    known = counts / counts.sum(axis=0)
    return [*names, UNKNOWN], np.concatenate([np.log(known), np.log(background(seen))[:, None] - UNKNOWN_MARGIN], axis=1).astype(np.float32)


SCORED = "text_scores array<double>, has_text boolean"


def score_texts(table, keys: int):
    """Mean trigram log-likelihood by language, weighted, in the last column's place; the first ``keys`` columns pass."""

    def run(batches):
        model = table.value
        for batch in slices(batches, keys):
            scores, has = np.zeros((batch.num_rows, model.shape[1])), np.zeros(batch.num_rows, bool)
            for piece in pieces(batch.column(keys)):
                slots = trigrams(piece.data)
                marks = np.concatenate([[0], np.cumsum(letters(piece.data))])
                for i, row in enumerate(piece.rows):
                    lo, hi = int(piece.bounds[i]), int(piece.bounds[i + 1])
                    n = hi - lo - 2
                    has[row] = marks[hi] > marks[lo]
                    if n > 0:
                        used = np.bincount(slots[lo : lo + n], minlength=SLOTS) if n > 4 * SLOTS else None
                        mean = (used @ model if used is not None else model[slots[lo : lo + n]].sum(axis=0, dtype=np.float64)) / n
                        scores[row] = mean * TEXT_WEIGHT * min(n, TEXT_BYTES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], pa.array(list(scores), pa.list_(pa.float64())), pa.array(has)], names=[*batch.schema.names[:keys], "text_scores", "has_text"])

    return run


def text_share(n: int):
    """Posterior by text alone: softmax of text_scores."""
    top = F.array_max("text_scores")
    e = F.transform("text_scores", lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def tallies(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Votes by language for each key: one column per language, summed before the shuffle."""
    return df.groupBy(*keys).agg(*(F.sum(F.when(F.col("vote") == j, 1.0).otherwise(0.0)).alias(f"n{j}") for j in range(n)))


def as_array(n: int, prefix: str = "n"):
    return F.array(*(F.col(f"{prefix}{j}") for j in range(n)))


def fuse(pages: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """(key, text, declared, suffix, domain, host) -> key, lang, confidence, text_lang, text_confidence, has_text, host_prior.

    Null evidence says nothing and changes nothing. Without letters there is no text evidence; without any evidence the
    corpus-wide prior decides. Ties go to the first language in order. An empty model gives a null language."""
    spark, n = pages.sparkSession, max(len(names), 1)
    ship(spark)
    model = spark.sparkContext.broadcast(table)
    cols = ["key", "declared", "suffix", "domain", "host"]
    key = pages.schema["key"].dataType.simpleString()
    scored = pages.select(*cols, "text").mapInArrow(score_texts(model, len(cols)), f"key {key}, declared string, suffix string, domain string, host string, {SCORED}")
    scored = scored.withColumn("share", text_share(n)).withColumn("vote", F.when(F.col("has_text"), (F.array_position("share", F.array_max("share")) - 1).cast("int")))
    scored = materialize(scored, "text-scores")
    votes = scored.filter("vote is not null")
    counted = tallies(votes, [], n).collect()[0]
    total = np.array([counted[f"n{j}"] or 0.0 for j in range(n)]) + 1.0
    world = total / total.sum()

    def likelihood(column: str) -> DataFrame:
        """log p(value | language) with one pseudo-count for a value, up to a constant for each value."""
        t = tallies(votes.filter(F.col(column).isNotNull()), [column], n)
        return t.select(F.col(column).alias(f"{column}_key"), F.array(*(F.log((F.col(f"n{j}") + world[j]) / F.lit(float(total[j]))) for j in range(n))).alias(f"{column}_log"))

    own = lambda j: F.when(F.col("vote") == j, 1.0).otherwise(0.0)
    domains = tallies(votes.filter("domain is not null"), ["domain"], n).select(F.col("domain").alias("domain_key"), as_array(n).alias("domain_n"))
    hosts = tallies(votes.filter("host is not null"), ["host"], n).select(F.col("host").alias("host_key"), as_array(n).alias("host_n"))
    d = scored
    for column in ("declared", "suffix"):
        t = likelihood(column)
        d = d.join(t, F.col(column) == F.col(f"{column}_key"), "left")
    d = d.join(domains, F.col("domain") == F.col("domain_key"), "left").join(hosts, F.col("host") == F.col("host_key"), "left")
    none = F.array(*[F.lit(0.0)] * n)
    mine = F.array(*(own(j) for j in range(n)))
    less = lambda counts: F.zip_with(F.coalesce(counts, none), mine, lambda c, o: F.greatest(c - o, F.lit(0.0)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    top = F.array(*(F.lit(float(w)) for w in world))
    d = d.withColumn("dn", less(F.col("domain_n"))).withColumn("hn", less(F.col("host_n")))
    d = d.withColumn("domain_prior", F.zip_with("dn", top, lambda c, up: c + SMOOTH * up)).withColumn("domain_prior", F.transform("domain_prior", lambda x: x / (add(F.col("dn")) + SMOOTH)))
    d = d.withColumn("host_prior", F.zip_with("hn", "domain_prior", lambda c, up: c + SMOOTH * up)).withColumn("host_prior", F.transform("host_prior", lambda x: x / (add(F.col("hn")) + SMOOTH)))
    text = F.when(F.col("has_text"), F.col("text_scores")).otherwise(none)
    total_log = F.zip_with(F.zip_with(text, F.coalesce("declared_log", none), lambda a, b: a + b), F.zip_with(F.coalesce("suffix_log", none), F.transform("host_prior", lambda p: F.log(p)), lambda a, b: a + b), lambda a, b: a + b)
    d = d.withColumn("total_log", total_log).withColumn("weight", F.transform("total_log", lambda s: F.exp(s - F.array_max("total_log"))))
    d = d.withColumn("best", F.array_position("weight", F.array_max("weight")).cast("int"))
    label = F.array(*(F.lit(x) for x in names)) if names else F.array(F.lit(None).cast("string"))
    return d.select(
        "key",
        F.element_at(label, F.col("best")).alias("lang"),
        (F.lit(1.0) / add(F.col("weight"))).alias("confidence"),
        F.when(F.col("has_text"), F.element_at(label, F.coalesce("vote", F.lit(0)) + 1)).alias("text_lang"),
        F.when(F.col("has_text"), F.array_max("share")).alias("text_confidence"),
        "has_text",
        F.element_at("host_prior", F.col("best")).alias("host_prior"),
        "declared",
        "host",
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> key, text without markup, declared language, suffix, domain and host."""
    html = F.col("html").cast("string")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.nullif(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    parts = F.split(host, r"\.")
    return pages.select(F.col("page_id").cast("long").alias("key"), text.alias("text"), declared.alias("declared"), F.element_at(parts, -1).alias("suffix"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"), host.alias("host"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page: page_id, lang, confidence, text_lang, declared, host and what each says.

    A page without a text, a declaration or a host is judged by the rest; repeated rows are judged alike; an empty table
    gives an empty result."""
    names, table = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return fuse(page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")), names, table).withColumnRenamed("key", "page_id")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without letters, or whose best class is ``UNKNOWN`` or has a posterior under
    ``LEAST_CONFIDENCE``, go.

    A document's source stands for its host; documents declare nothing and have no address. Null and empty texts have no
    letters and go. Rows without an id train and are judged like others. Every row is judged by its own text, rows without an id and rows that repeat an id too; rows that
    repeat an id and a text share their decision. An empty table, or one without labels, gives an empty result; columns of
    any other name are left alone."""
    names, table = fit(docs)
    none = F.lit(None).cast("string")
    keyed, one, two = with_key(docs)
    source = F.col("source").cast("string")
    evidence = keyed.select(F.struct(F.col(one).alias("ord"), F.col(two).alias("row")).alias("key"), F.col("text").cast("string").alias("text"), none.alias("declared"), none.alias("suffix"), source.alias("domain"), source.alias("host"))
    found = fuse(evidence, names, table)
    kept = found.filter(F.col("has_text") & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("lang") != UNKNOWN)).select(F.col("key.ord").alias(one), F.col("key.row").alias(two))
    return keyed.join(kept, [one, two], "left_semi").select(docs.columns)
