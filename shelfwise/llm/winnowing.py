"""Benchmark decontamination by winnowing: words of a document that stand in a 10-word window of a benchmark item.

Every 10-word window keeps its least 5-gram hash, in the items and in the documents, so a shared window always shares a
fingerprint. Documents look their fingerprints up in the items', and a hit is extended to the windows it stands for,
which are compared by their own hash. Items of fewer than 10 words are one window and are looked up at every place.

The item windows are broadcast in blocks of at most ``BLOCK_WINDOWS`` rows (about 24 bytes each), counted first; a larger
benchmark takes one pass over the documents for each block, and the findings are merged by document."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.repeats import NO_ID, plain, with_key
from shelfwise.llm.session import materialize, ship
from shelfwise.llm.text import gram_starts, merge_spans, pieces, prefix_sums, slices, span_hash, winnow, words

WINDOW = 10
GRAM = 5
BLOCK_WINDOWS = 1 << 20


def item_windows(batches):
    """(item_id, text) -> a row per window: its hash, its fingerprint and its length in words."""
    for batch in batches:
        ids = batch.column(0)
        for piece in pieces(batch.column(1)):
            w = words(piece, "alnum", lower=True)
            if not len(w.hash):
                continue
            sums = prefix_sums(w.hash)
            a = winnow(sums, w.bounds, GRAM, WINDOW)
            at = np.flatnonzero(gram_starts(w.bounds, WINDOW))
            key = np.repeat(a.key, a.last - a.first + 1)
            short = np.flatnonzero((w.count() > 0) & (w.count() < WINDOW))
            lo, hi = w.bounds[short], w.bounds[short + 1]
            whole = np.concatenate([span_hash(sums, at, at + WINDOW), span_hash(sums, lo, hi)])
            key = np.concatenate([key, np.zeros(len(short), np.uint64)])
            size = np.concatenate([np.full(len(at), WINDOW), hi - lo])
            doc = np.concatenate([w.doc[at], short]) + piece.rows.start
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(whole.view(np.int64)), pa.array(key.view(np.int64)), pa.array(size)], names=["item_id", "whole", "key", "size"])


class Index:
    """One block of item windows: sorted fingerprints, and for each window length its sorted hashes with their items."""

    def __init__(self, table: pa.Table):
        names, item = np.unique(np.array(table.column("item_id").to_pylist(), object).astype(str), return_inverse=True) if table.num_rows else (np.empty(0, str), np.empty(0, np.int64))
        whole = table.column("whole").to_numpy().view(np.uint64)
        key = table.column("key").to_numpy().view(np.uint64)
        size = table.column("size").to_numpy()
        self.names = names
        self.keys = np.unique(key[size == WINDOW])
        self.by_size = {}
        for n in np.unique(size).tolist():
            h, i = whole[size == n], item[size == n]
            order = np.argsort(h, kind="stable")
            h, i = h[order], i[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            self.by_size[n] = h[at], np.concatenate([at, [len(h)]]), i

    def known(self, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, values)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == values) if len(self.keys) else np.zeros(len(values), bool)

    def lookup(self, n: int, values: np.ndarray) -> np.ndarray:
        """Row of each value among the hashes of windows of n words, or -1."""
        hashes = self.by_size[n][0]
        at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
        return np.where(hashes[at] == values, at, -1)

    def items(self, n: int, rows: np.ndarray) -> set:
        _, bounds, item = self.by_size[n]
        return {int(x) for r in np.unique(rows) for x in item[bounds[r] : bounds[r + 1]]}


def findings(index):
    """(ord, row, text) -> FOUND: number of words, spans of hit words (int64 pairs), items."""

    def run(batches):
        known = index.value
        for batch in slices(batches, 2):
            out = []
            for piece in pieces(batch.column(2)):
                w = words(piece, "alnum", lower=True)
                sums = prefix_sums(w.hash)
                spans: dict[int, list] = {}
                items: dict[int, set] = {}

                def note(at, row, n, w=w, spans=spans, items=items):
                    at, row = at[row >= 0], row[row >= 0]
                    doc = w.doc[at]
                    for d in np.unique(doc).tolist():
                        mine = doc == d
                        spans.setdefault(d, []).append(np.stack([at[mine], at[mine] + n], axis=1) - w.bounds[d])
                        items.setdefault(d, set()).update(known.items(n, row[mine]))

                for n in known.by_size:
                    if n == WINDOW:
                        a = winnow(sums, w.bounds, GRAM, WINDOW)
                        hit = known.known(a.key)
                        at = np.concatenate([np.arange(f, e + 1) for f, e in zip(a.first[hit], a.last[hit], strict=True)]) if hit.any() else np.empty(0, np.int64)
                    else:
                        at = np.flatnonzero(gram_starts(w.bounds, n)) if len(w.hash) else np.empty(0, np.int64)
                    if len(at):
                        note(at, known.lookup(n, span_hash(sums, at, at + n)), n)
                n_words = w.count()
                for i, row in enumerate(piece.rows):
                    raw = np.concatenate(spans[i]).astype(np.int64).tobytes() if i in spans else b""
                    out.append((row, int(n_words[i]), raw, sorted(str(known.names[x]) for x in items.get(i, ()))))
            take = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.list_(pa.string()))], names=["ord", "row", "n_words", "spans", "items"])

    return run


RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
SUMMARY = "ord long, row long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
FOUND = "ord long, row long, n_words long, spans binary, items array<string>"


def summary(batch, spans: list[list[bytes]], items: list[list[list[str]]]):
    hits, n_items, digests = [], [], []
    for some, found in zip(spans, items, strict=True):
        pairs = np.frombuffer(b"".join(some), np.int64).reshape(-1, 2)
        start, end = merge_spans(pairs[:, 0], pairs[:, 1])
        names = sorted({x for part in found for x in part})
        hits.append(int((end - start).sum()))
        n_items.append(len(names))
        digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:3], pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())],
        names=["ord", "row", *RESULT],
    )


def contamination(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> RESULT, one row per row of ``docs``.

    Null texts have no words; items without words, and items without an id, are no items. Repeated items count once by
    id. Windows that overlap hit each word once. Every row is judged by its own text, whether its id is repeated or null.
    Extra columns are ignored; an empty benchmark hits nothing. Windows are compared by two 64-bit hashes."""
    found = judged(plain(docs).select("ord", "row", "text"), items, block_windows)
    return found.select(F.when(F.col("ord") < NO_ID, F.col("ord")).alias("doc_id"), *RESULT)


def judged(docs: DataFrame, items: DataFrame, block_windows: int) -> DataFrame:
    """(ord, row, text) -> ord, row and RESULT of every row."""
    spark = docs.sparkSession
    ship(spark)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    windows = materialize(items.mapInArrow(item_windows, "item_id string, whole long, key long, size long").distinct(), "item-windows")
    n_blocks = max(1, -(-windows.count() // block_windows))
    if n_blocks == 1:
        index = spark.sparkContext.broadcast(Index(windows.toArrow()))

        def run(batches):
            for batch in findings(index)(batches):
                yield summary(batch, [[x] for x in batch.column(3).to_pylist()], [[x] for x in batch.column(4).to_pylist()])

        return docs.mapInArrow(run, SUMMARY)
    parts = []
    for block in range(n_blocks):
        mine = windows.filter(F.pmod(F.xxhash64("whole", "item_id"), F.lit(n_blocks)) == block)
        index = spark.sparkContext.broadcast(Index(mine.toArrow()))
        parts.append(materialize(docs.mapInArrow(findings(index), FOUND).filter("length(spans) > 0").select("ord", "row", "spans", "items").distinct(), "findings"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    merged = merged.groupBy("ord", "row").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    empty = spark.sparkContext.broadcast(Index(windows.limit(0).toArrow()))
    joined = docs.mapInArrow(findings(empty), FOUND).select("ord", "row", "n_words").join(merged, ["ord", "row"], "left")
    none = F.array().cast("array<binary>"), F.array().cast("array<array<string>>")

    def gather(batches):
        for batch in batches:
            yield summary(batch, batch.column(3).to_pylist(), batch.column(4).to_pylist())

    return joined.select("ord", "row", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")).mapInArrow(gather, SUMMARY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a hit word go; all columns of the others stay.

    Every row is judged by its own text: null and empty texts stay, rows without an id and rows that repeat an id like all
    others. An empty table gives an empty result; columns of any other name are left alone."""
    found = judged(plain(docs).select("ord", "row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), BLOCK_WINDOWS)
    keyed, one, two = with_key(docs)
    bad = found.filter("contaminated").select(F.col("ord").alias(one), F.col("row").alias(two))
    return keyed.join(bad, [one, two], "left_anti").select(docs.columns)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
iwin AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS whole FROM iw, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(i) WHERE len(words) > 0),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS whole FROM dw, lens, unnest(range(1, len(words) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dwin.n, item_id FROM dwin JOIN iwin ON dwin.n = iwin.n AND dwin.whole = iwin.whole),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hits, unnest(range(0, n)) AS t(o) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
