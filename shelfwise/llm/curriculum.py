"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time 0..1, as straight lines between knots; its integral is the source's
weight. Weights share the words of the mix; no source is read more than ``REPEATS`` times, and what it leaves is reshared
by weight. The demand of a source up to a time is its target times the integrated schedule, so a document that starts
after so many words of its source gets the time at which the demand has reached them: the schedule inverted. Rows sorted
by range of that position are the training order."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.merkle import group_key
from shelfwise.llm.ranks import running
from shelfwise.llm.session import drop_scratch, materialize, ship
from shelfwise.llm.text import pieces, separators, slices

#: (time, weight) knots of the schedules that sources take in turn; they integrate to 3, 1 and 2.
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 5.0)))
SHARE, REPEATS = 1.5, 2


def integral(knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def time_of(share: Column, knots) -> Column:
    """The time at which the integrated schedule has reached ``share`` (0..1) of its whole."""
    wanted, done, out = share * integral(knots), 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area, bend = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        x = F.greatest(wanted - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * bend * x, F.lit(0.0)))
        here = F.when(x <= 0, t0).otherwise(F.least(t0 + 2 * x / (w0 + root), F.lit(t1)))
        out = here if out is None else F.when(wanted > done, here).otherwise(out)
        done += area
    return out


def count_words(at: int):
    """Batches with the number of [^\\x20\\x09-\\x0D]+ words of the text in column ``at`` in its place."""
    space = separators("space")

    def run(batches):
        for batch in slices(batches, at):
            sizes = np.zeros(batch.num_rows, np.int64)
            for piece in pieces(batch.column(at)):
                inside = ~space[piece.data]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                heads = piece.bounds[:-1][np.diff(piece.bounds) > 0]
                begins[heads] = inside[heads]
                seen = np.concatenate([[0], np.cumsum(begins)])
                sizes[piece.rows.start : piece.rows.stop] = seen[piece.bounds[1:]] - seen[piece.bounds[:-1]]
            columns = list(batch.columns)
            columns[at] = pa.array(sizes)
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:at], "size", *batch.schema.names[at + 1 :]])

    return run


def targets(sizes: DataFrame, schedules, share: float, repeats: int) -> DataFrame:
    """(source, size) -> a row per source, written: source, source_size, schedule (its number in turn, sources by code point,
    null last) and target.

    Sources that reach ``repeats`` times their size are fixed there and the rest is shared anew by weight, until no other
    one does: an aggregate over the sources each time, of which two sums come to the driver."""
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(0))
    one = materialize(one, "sources")
    ranked = running(one, ["one"], [F.when(F.col("source") == "", 1).otherwise(0), F.col("source")], name="place", total="n_sources")
    weight = F.element_at(F.array(*(F.lit(integral(k)) for k in schedules)), (F.col("place") % len(schedules) + 1).cast("int"))
    all_of = ranked.select("source", "source_size", (F.col("place") % len(schedules)).cast("int").alias("schedule"), weight.alias("weight"), (F.col("source_size") * float(repeats)).alias("most"))
    wanted = share * float(all_of.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = 0.0, -1
    while True:
        reached = F.col("most") <= F.col("weight") * level
        row = all_of.agg(F.count_if(reached), F.sum(F.when(reached, F.col("most")).otherwise(0.0)), F.sum(F.when(reached, 0.0).otherwise(F.col("weight")))).first()
        if row[0] == full:
            break
        full = row[0]
        level = (wanted - row[1]) / row[2] if row[2] else math.inf
    target = F.col("most") if math.isinf(level) else F.least("most", F.col("weight") * level)
    out = materialize(all_of.select("source", "source_size", "schedule", target.alias("target")), "targets")
    drop_scratch(one, ranked)
    return out


def training_order(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, repeats: int = REPEATS, seed: int = 1) -> DataFrame:
    """docs (doc_id, source, text) -> the mix in training order, written: row (one for each row of ``docs``), doc_id, size,
    source_size, target, pass (from 0), words and position (0 to 1).

    Within its source a document comes by the sha256 of ``seed:doc_id``, then id and size, in every pass; each pass takes
    whole documents, but for the last one of a source, which is cut where the source's target, rounded to whole words, is
    reached: ``words`` counts from its start. Documents of which nothing is taken keep one row, with pass and position null
    and 0 words, after all others. Order and cuts follow from ids and sizes alone, so reruns agree.

    A null text has size 0, a null source is a source of its own after all others, rows without an id take part (as if
    their id were empty), repeated rows are documents of their own. An empty table gives an empty result."""
    ship(docs.sparkSession)
    # a source's key is never null; "" stands for none
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    sizes = plain.mapInArrow(count_words(2), "doc_id long, source string, size long")
    sizes = materialize(sizes.select("*", F.monotonically_increasing_id().alias("row"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("mark")), "sizes")
    of_source = targets(sizes, schedules, share, repeats)
    placed = running(sizes, ["source"], [F.col("mark"), F.col("doc_id").asc_nulls_last(), F.col("size")], amount="size", beside=of_source)
    need = F.floor(F.col("target") + 0.5)
    passes = []
    for p in range(repeats):
        start = F.col("before") + p * F.col("source_size")
        words = F.least(F.greatest(need - start, F.lit(0)), F.col("size"))
        at = F.least(F.try_divide(start.cast("double"), F.col("target")), F.lit(1.0))
        position = time_of(at, schedules[0])
        for i, knots in enumerate(schedules[1:], 1):
            position = F.when(F.col("schedule") == i, time_of(at, knots)).otherwise(position)
        passes.append(F.when(words > 0, F.struct(F.lit(p).alias("pass"), words.cast("long").alias("words"), position.alias("position"))))
    taken = placed.select("row", "doc_id", "size", "source_size", "target", "mark", F.explode_outer(F.array_compact(F.array(*passes))).alias("take"))
    flat = taken.select("row", "doc_id", "size", "source_size", "target", "mark", "take.pass", F.coalesce("take.words", F.lit(0)).alias("words"), "take.position")
    keys = [F.col("position").asc_nulls_last(), F.col("mark"), F.col("row")]
    out = materialize(flat.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("mark"), "training-order")
    drop_scratch(sizes, of_source, placed)
    return out


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("words").alias("taken")).drop("row")


OP13_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source = '', source) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
m AS (SELECT *, source_size * CAST({REPEATS} AS DOUBLE) AS most, CAST({SHARE} AS DOUBLE) * (SELECT sum(source_size) FROM s)::DOUBLE AS wanted FROM s),
r AS (SELECT a.source, sum(least(b.most, a.most / a.weight * b.weight)) <= any_value(a.wanted) AS reached FROM m a, m b GROUP BY a.source),
l AS (SELECT (any_value(wanted) - coalesce(sum(most) FILTER (reached), 0)) / sum(weight) FILTER (NOT reached) AS level FROM m JOIN r USING (source)),
t AS (SELECT source, source_size, least(most, weight * coalesce(level, 'inf'::DOUBLE)) AS target FROM m, l),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mark, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t USING (source))
SELECT doc_id, size, source_size, target, CAST({' + '.join(f'least(greatest(floor(target + 0.5) - (before + {k} * source_size), 0), size)' for k in range(REPEATS))} AS BIGINT) AS taken FROM p
"""
