"""Line dedup by a log-template tree.

Lines are parsed to a fixed depth: number of tokens, then the first ``DEPTH`` tokens. Tokens with a digit are variable
fields from the start. In a leaf, a token stays in the template where at least ``SUPPORT`` line-documents (pairs of a
document and one of its different lines) share it at its position; the others are generalised. A line follows its
template if at least ``LEAST_CONSTANT`` of its tokens stay; else its masked text is a template of its own, if as many of
its tokens are no variable fields. All other lines, and those of fewer than ``LEAST_TOKENS`` tokens, stand for themselves,
digits and all. What stands in two different documents recurs: all its lines are dropped, except the first line of the
first document, so that one copy of everything stays. Lines and templates are known by 128 bits.

Counts are summed before each shuffle, lines of one text are one row, and places are joined by line only, so a line or a
template that a third of all documents hold is a row per task, or is split by Spark's skew join."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.repeats import plain, with_key
from shelfwise.llm.session import drop_scratch, free_name, materialize, member, membership, ship
from shelfwise.llm.text import slices

LEAST_TOKENS, DEPTH, SUPPORT, LEAST_CONSTANT = 4, 2, 10, 0.6
#: Lines of nothing but these are blank.
BLANK = " \t\r\x0b\x0c"
_variable = re.compile("[^ ]*[0-9][^ ]*")
_digit = re.compile("[0-9]")


def hashed(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, j])) for j in range(2)]


def parse(text: str):
    """(line number, 128 bits of the line, leaf or None, masked line or None) of every line that is not blank. Lines of the
    tree are known by their masked text, others by themselves."""
    for number, line in enumerate(text.split("\n")):
        if not line.strip(BLANK):
            continue
        n = line.count(" ") + 1
        if n >= LEAST_TOKENS:
            masked, fixed = line, n
            if _digit.search(line) or "<*>" in line:
                masked = _variable.sub("<*>", line)
                fixed = n - masked.split(" ").count("<*>")
            if fixed >= n * LEAST_CONSTANT:
                lead = masked.split(" ", DEPTH)[:DEPTH]
                leaf = int.from_bytes(hashed(f"{n} {' '.join(lead)}")[:8], "little", signed=True)
                yield number, hashed("masked " + masked), leaf, masked
                continue
        yield number, hashed("line " + line), None, None


def line_counts(batches):
    """text -> a row per line text of a batch: its leaf and the documents that hold it."""
    for batch in slices(batches, 0):
        found: dict[bytes, list] = {}
        for text in batch.column(0).to_pylist():
            for line, leaf in {h: leaf for _, h, leaf, _ in parse(text or "")}.items():
                mine = found.get(line)
                if mine is None:
                    found[line] = [leaf, 1]
                else:
                    mine[1] += 1
        yield pa.RecordBatch.from_arrays([*halves(list(found)), *(pa.array([v[j] for v in found.values()], pa.int64()) for j in range(2))], names=["one", "two", "leaf", "n_docs"])


PLACE = "one long, two long, leaf long, ord long, row long, number long, masked string"


def lines_in(leaves, repeated):
    """(ord, row, text) -> PLACE: the lines that may recur, by themselves or by their leaf; of those of the tree a batch gives
    the text once."""

    def run(batches):
        in_tree, again = member(leaves), member(repeated)
        for batch in slices(batches, 2):
            out, seen = [], set()
            for order, row, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for number, line, leaf, masked in parse(text or ""):
                    out.append((line, leaf, order, row, number, None if line in seen else masked))
                    seen.add(line)
            one, two = halves([o[0] for o in out])
            cols = list(zip(*out, strict=True)) or [()] * 6
            leaf = pa.array(cols[1], pa.int64())
            keep = np.ones(len(out), bool)
            if out and in_tree and again:
                keep = again.has(np.asarray(one).view(np.uint64)) | (leaf.is_valid().to_numpy(zero_copy_only=False) & in_tree.has(np.asarray(leaf.fill_null(0)).view(np.uint64)))
            made = pa.RecordBatch.from_arrays([one, two, leaf, *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.string())], names=["one", "two", "leaf", "ord", "row", "number", "masked"])
            yield made.filter(pa.array(keep))

    return run


LINE, KEY = ["one", "two"], ["key_one", "key_two"]


def dropped_lines(docs: DataFrame) -> DataFrame:
    """docs (as ``repeats.plain`` gives them) -> ord, row, numbers (of its lines that go), written."""
    lines = materialize(docs.select("text").mapInArrow(line_counts, "one long, two long, leaf long, n_docs long").groupBy(*LINE, "leaf").agg(F.sum("n_docs").alias("n_docs")), "lines")
    leaves = materialize(lines.filter("leaf is not null").groupBy("leaf").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= SUPPORT).select("leaf"), "leaves")
    repeated = materialize(lines.filter("n_docs > 1").select("one"), "repeated-lines")
    places = docs.select("ord", "row", "text").mapInArrow(lines_in(membership(leaves, "leaf"), membership(repeated, "one")), PLACE)
    held = places = materialize(places, "places")
    texts = places.filter("masked is not null").groupBy(*LINE).agg(F.min("masked").alias("masked"))
    leaf_lines = materialize(lines.join(leaves, "leaf", "left_semi").join(texts, LINE), "leaf-lines")
    tokens = leaf_lines.select(*LINE, "leaf", "n_docs", F.posexplode(F.split("masked", " ", -1)).alias("pos", "token"))
    constant = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n_docs").alias("n")).filter((F.col("n") >= SUPPORT) & (F.col("token") != "<*>")).select("leaf", "pos", "token", F.lit(True).alias("stays"))
    marked = tokens.join(constant, ["leaf", "pos", "token"], "left").withColumn("token", F.when(F.col("stays"), F.col("token")).otherwise("<*>"))
    shaped = marked.groupBy(*LINE, "leaf").agg(F.count("stays").alias("n_constant"), F.count("*").alias("n_tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("template"))
    followed = shaped.filter(F.col("n_constant") >= F.col("n_tokens") * LEAST_CONSTANT).select(*LINE, F.xxhash64(F.lit("template"), "leaf", "template").alias("key_one"), F.xxhash64("template", "leaf", F.lit("template")).alias("key_two"))
    followed = materialize(followed, "followed")
    places = places.select(*LINE, "ord", "row", "number")
    keyed = places.join(followed, LINE, "left").select("ord", "row", "number", F.coalesce("key_one", "one").alias("key_one"), F.coalesce("key_two", "two").alias("key_two"))
    in_docs = keyed.groupBy(*KEY, "ord", "row").agg(F.min("number").alias("number"))
    recurring = in_docs.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("ord", "row", "number")).alias("at")).filter(F.col("n") > 1).select(*KEY, "at")
    recurring = materialize(recurring, "recurring")
    # a key of a line that follows no template is the line itself
    of_line = materialize(followed.join(recurring, KEY).select(*LINE, "at").union(recurring.join(followed.select(F.col("one").alias("key_one"), F.col("two").alias("key_two")), KEY, "left_anti").select(*KEY, "at")), "recurring-lines")
    gone = places.join(of_line, LINE).filter(F.struct("ord", "row", "number") != F.col("at"))
    out = materialize(gone.groupBy("ord", "row").agg(F.collect_set("number").alias("numbers")), "dropped-lines")
    drop_scratch(lines, leaves, repeated, held, leaf_lines, followed, recurring, of_line)
    return out


def without_lines(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs -> (the same columns, ``text`` without the dropped lines, and two more columns; the names of those two: lines
    before and lines dropped). They are lines_before and lines_dropped, with underscores in front if ``docs`` has those.

    Lines end at newlines; blank ones always stay. A null text has no lines and stays null. A document may end up empty. A
    document is an id and a text: rows that repeat an id with another text have lines of their own, rows without an id come
    after all others, and rows that repeat both are one document and lose the same lines. An empty table gives an empty
    result."""
    ship(docs.sparkSession)
    gone = dropped_lines(plain(docs))
    keyed, one, two = with_key(docs)
    numbers, before, dropped = (free_name(keyed, c) for c in ("_numbers", "lines_before", "lines_dropped"))
    # merged at every size: what is dropped grows with the corpus, so a plan that broadcasts it does not last
    joined = keyed.join(gone.select(F.col("ord").alias(one), F.col("row").alias(two), F.col("numbers").alias(numbers)).hint("merge"), [one, two], "left")
    lines = F.split("text", "\n", -1)
    # the set difference of numbers is linear, a look-up for each line would not be
    kept = F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col(numbers)), lambda i: F.get(lines, i.cast("int")))
    cut = F.when(F.col(numbers).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    known = F.col("text").isNotNull()
    counts = F.when(known, F.size(lines)).otherwise(0).cast("long").alias(before), F.when(known & F.col(numbers).isNotNull(), F.size(numbers)).otherwise(0).cast("long").alias(dropped)
    return joined.select(*(cut.alias(c) if c == "text" else F.col(c) for c in docs.columns), *counts), before, dropped


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without its recurring template lines; n_chars follows the text. Nulls,
    repeated rows and empty tables are as ``without_lines`` has them; columns of any other name are left alone."""
    out, _, dropped = without_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, before, dropped = without_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col(before).alias("n_lines"), F.col(dropped).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_TOKENS = "string_split(masked, ' ')"
OP9_SQL = f"""
WITH l AS (SELECT doc_id, i - 1 AS number, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
n AS (SELECT doc_id, number, line, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
m AS (SELECT *, len({_TOKENS}) >= {LEAST_TOKENS} AND len(list_filter({_TOKENS}, lambda t: t <> '<*>')) >= len({_TOKENS}) * CAST({LEAST_CONSTANT} AS DOUBLE) AS in_tree FROM n),
b AS (SELECT doc_id, number, in_tree, masked, CASE WHEN in_tree THEN 'masked ' || masked ELSE 'line ' || line END AS base FROM m),
k AS (SELECT base, masked, concat_ws(' ', len({_TOKENS}), {', '.join(f"{_TOKENS}[{i + 1}]" for i in range(DEPTH))}) AS leaf, count(DISTINCT doc_id) AS n_docs FROM b WHERE in_tree GROUP BY base, masked),
t AS (SELECT base, leaf, n_docs, p, {_TOKENS}[p] AS token FROM k, unnest(range(1, len({_TOKENS}) + 1)) AS u(p)),
c AS (SELECT leaf, p, token FROM t GROUP BY leaf, p, token HAVING sum(n_docs) >= {SUPPORT} AND token <> '<*>'),
s AS (SELECT t.base, count(c.token) AS n_constant, count(*) AS n_tokens, any_value(t.leaf) || ' | ' || string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY t.p) AS template FROM t LEFT JOIN c ON t.leaf = c.leaf AND t.p = c.p AND t.token = c.token GROUP BY t.base),
f AS (SELECT b.doc_id, b.number, CASE WHEN n_constant >= n_tokens * CAST({LEAST_CONSTANT} AS DOUBLE) THEN 'template ' || template ELSE b.base END AS key FROM b LEFT JOIN s ON s.base = b.base),
r AS (SELECT key, min(struct_pack(doc_id := doc_id, number := number)) AS at FROM f GROUP BY key HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT f.doc_id, f.number FROM f JOIN r ON f.key = r.key WHERE f.doc_id <> r.at.doc_id OR f.number <> r.at.number),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.number) AS n_dropped, string_agg(CASE WHEN gone.number IS NULL THEN line END, chr(10) ORDER BY l.number) AS text FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.number = l.number GROUP BY l.doc_id)
SELECT doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM kept JOIN documents d USING (doc_id)
"""
