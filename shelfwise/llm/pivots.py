"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``LENGTH`` nearest pivots in order. It is posted in the inverted files of its ``POSTED``
nearest pivots; a query opens the files of its ``PROBED`` nearest ones, ranks the postings by footrule distance between
the ordered lists (a pivot that a list lacks counts as standing at its end), and the nearest ``KEEP`` of each file, with
all others at the distance of the last of them, are reranked by inner product on the original vectors, in double
precision. So vectors that are equal are kept or left together, and the smallest ids of them can be found.

Pivots are a bounded sample of different vectors (``PIVOTS``, least hash first); every row is indexed. Files of more than
``PART_ROWS`` postings are cut into parts by a hash of the id, and a query goes to all parts, so a pivot that holds a
third of the vectors is spread like the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.session import materialize, ship, shuffle_width

PIVOTS, LENGTH, POSTED, PROBED, KEEP, KEEP_LEAST, PART_ROWS, QUERY_BLOCK = 64, 24, 2, 28, 0.35, 256, 4096, 64
SPARE = 8  # rows looked at for each pivot, as pivots are different vectors


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null or zero and whose components are finite."""
    v = F.col("embedding")
    fit = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & fit)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest_pivots(pivots, depth_of):
    """(vec_id, embedding, kind) -> a row for each file: file, kind, vec_id, embedding, ranks (its ordered list as bytes)."""

    def run(batches):
        p = pivots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(matrix(batch.column(1)) @ p.T), axis=1, kind="stable")
            kinds = batch.column(2).to_numpy()
            for kind in (0, 1):
                rows = np.flatnonzero(kinds == kind)
                depth = min(depth_of[kind], len(p))
                if not len(rows):
                    continue
                take = pa.array(np.repeat(rows, depth))
                lists = order[rows, : min(LENGTH, len(p))].astype(np.int16)
                raw = pa.array([x.tobytes() for x in lists], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), depth)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[rows, :depth].ravel(), pa.int64()), pa.array(np.full(len(rows) * depth, kind), pa.int64()), batch.column(0).take(take), batch.column(1).take(take), raw], names=["file", "kind", "vec_id", "embedding", "ranks"]
                )

    return run


def thermometer(lists: np.ndarray, n_pivots: int) -> np.ndarray:
    """Ranks as unary codes in 64-bit words, so the footrule distance of two lists is the number of differing bits."""
    m = lists.shape[1]
    ranks = np.full((len(lists), n_pivots), m, np.int16)
    np.put_along_axis(ranks, lists.astype(np.int64), np.arange(m, dtype=np.int16)[None], 1)
    bits = (ranks[:, :, None] > np.arange(m, dtype=np.int16)).reshape(len(lists), -1)
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def search(n_pivots: int, k: int):
    """Rows sorted by file, part and kind (postings first) -> query_id, vec_id, score: the k best of each part."""

    def best(ids, x, codes, queries):
        keep = min(len(ids), max(KEEP_LEAST, int(np.ceil(KEEP * len(ids)))))
        reach = np.sqrt((x * x).sum(axis=1).max())
        for lo in range(0, len(queries[0]), QUERY_BLOCK):
            q_ids, q, q_codes = (a[lo : lo + QUERY_BLOCK] for a in queries)
            far = np.zeros((len(q_ids), len(ids)), np.int32)
            for w in range(codes.shape[1]):
                far += np.bitwise_count(q_codes[:, w, None] ^ codes[None, :, w])
            out = []
            for i in range(len(q_ids)):
                near = np.flatnonzero(far[i] <= np.partition(far[i], keep - 1)[keep - 1]) if keep < len(ids) else np.arange(len(ids))
                near = near[ids[near] != q_ids[i]]
                score = x[near] @ q[i]  # its last digits depend on the place of a row
                if len(near) > k:
                    near = near[score >= np.partition(score, -k)[-k] - 1e-9 * reach * np.linalg.norm(q[i])]
                score = (x[near] * q[i]).sum(axis=1)
                top = np.lexsort((ids[near], -score))[:k]
                out.append((np.full(len(top), q_ids[i]), ids[near][top], score[top]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=["query_id", "vec_id", "score"])

    def run(batches):
        key, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("file", "part", "kind")], axis=1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(keys)], strict=True):
                file, part, kind = keys[lo].tolist()
                some = batch.slice(lo, hi - lo)
                lists = np.frombuffer(b"".join(some.column("ranks").to_pylist()), np.int16).reshape(len(some), -1)
                rows = some.column("vec_id").to_numpy(), matrix(some.column("embedding")), thermometer(lists, n_pivots)
                if (file, part) != key:
                    key, held, ready = (file, part), [], None
                if kind == 0:
                    held.append(rows)
                elif held:
                    ready = ready or tuple(np.concatenate([h[j] for h in held]) for j in range(3))
                    yield from best(*ready, rows)

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score for every row that ``is_query`` accepts.

    Candidates are all usable rows of another id and of the query's length, as vectors of different lengths have no inner
    product; each length that occurs has an index of its own. Ties go to the smaller id; repeated ids count once. Rows that
    are not usable take no part; a query without candidates has no rows. Extra columns are ignored."""
    ship(vectors.sparkSession)
    rows = materialize(usable(vectors), "vectors")
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy("size").collect()  # a row per length
    parts = [nearest_of_length(rows.filter(F.size("embedding") == r.size), r["count"], is_query, k) for r in sizes]
    out = parts[0] if parts else nearest_of_length(rows, 0, is_query, k)
    for part in parts[1:]:
        out = out.union(part)
    return out


def nearest_of_length(rows: DataFrame, n: int, is_query, k: int) -> DataFrame:
    """As ``nearest``, for n usable rows of one length."""
    spark = rows.sparkSession
    n_pivots = max(1, min(PIVOTS, n // 32))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots * SPARE).select("embedding").collect()
    sample = list({tuple(r.embedding): r for r in sample}.values())[:n_pivots]
    n_pivots = max(1, len(sample))
    probed = n_pivots if n_pivots <= 8 else min(PROBED, n_pivots)
    pivots = spark.sparkContext.broadcast(np.array([r.embedding for r in sample], dtype=np.float64).reshape(len(sample), len(sample[0].embedding) if sample else 0))
    every = rows.withColumn("kind", F.lit(0).cast("long"))
    asked = rows.filter(is_query).withColumn("kind", F.lit(1).cast("long"))
    schema = "file long, kind long, vec_id long, embedding array<double>, ranks binary"
    files = materialize(every.unionByName(asked).mapInArrow(nearest_pivots(pivots, (POSTED, probed)), schema), "files")
    counts = files.filter("kind = 0").groupBy("file").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    dealt = files.join(F.broadcast(counts), "file")  # one row per pivot
    posted = dealt.filter("kind = 0").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    probes = dealt.filter("kind = 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = posted.unionByName(probes).drop("parts").repartition(shuffle_width(spark), "file", "part").sortWithinPartitions("file", "part", "kind")
    found = both.mapInArrow(search(n_pivots, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
