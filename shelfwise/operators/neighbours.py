"""Exact k nearest neighbours of many rows among many, as a join by pivot cells and triangle bounds.

Known rows fall into the cell of their nearest pivot (square root of their number, at most ``MOST_PIVOTS``). A query is
first compared with the nearest cells that hold k rows; the k-th distance found there is its reach, and by the triangle
inequality only cells that the reach touches can hold anything nearer: it is sent to those and to no other. Cells are cut
into blocks of ``BLOCK`` rows and their visitors into chunks of ``CHUNK`` queries, so no task holds more, however many rows
share a cell. Equal vectors count once: k of them with the least ids are all that any query can want, and queries with
equal vectors are asked once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.files import stored

MOST_PIVOTS, BLOCK, CHUNK = 1024, 8192, 32768


def usable(vector: str):
    """Vectors that are there and hold finite numbers only."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column, n: int) -> np.ndarray:
    """Arrow list column -> n x dimensions."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of all rows of x to all of y, up to rounding."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None], 0))


def slack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """More than ``distances`` can be off, for each row of x."""
    return 1e-6 * (1 + np.sqrt((x * x).sum(axis=1)) + np.sqrt((y * y).sum(axis=1).max()))


def into_cells(pivots):
    """(id, vector) -> cell, dist, id, vector."""

    def run(batches):
        p = pivots.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), batch.num_rows)
                cell = distances(x, p).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.sqrt(((x - p[cell]) ** 2).sum(axis=1))), *batch.columns], names=["cell", "dist", "c", "v"])

    return run


class Cells:
    """Pivots and, for each cell, its number of rows and the least and largest distance from its pivot."""

    def __init__(self, pivots: np.ndarray, stats: np.ndarray):
        self.pivots = pivots
        self.rows, self.low, self.high = (stats[:, j] for j in range(3))

    def first(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances to pivots, and the nearest cells of each query that together hold k rows (a mask)."""
        d = distances(x, self.pivots)
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        chosen = np.zeros(d.shape, bool)
        np.put_along_axis(chosen, order, held - self.rows[order] < k, axis=1)
        return d, chosen & (self.rows > 0)

    def touched(self, x: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to pivots, and the cells besides the first ones that may hold a row within reach."""
        d, seen = self.first(x, k)
        own = d.argmin(axis=1)
        apart = distances(self.pivots, self.pivots)[own]
        ring = np.maximum(d - self.high, self.low - d)
        plane = np.divide(d**2 - np.take_along_axis(d, own[:, None], 1) ** 2, 2 * apart, out=np.zeros_like(d), where=apart > 0)
        wide = slack(x, self.pivots)[:, None]
        # the plane bound divides by the distance between pivots, so its rounding grows with d / apart
        wide_plane = wide * (1 + np.divide(2 * d, apart, out=np.zeros_like(d), where=apart > 0))
        near = (ring <= reach[:, None] + wide) & (plane <= reach[:, None] + wide_plane)
        return d, near & ~seen & (self.rows > 0)


def visits(cells, k: int, dealt):
    """(q, vector, reach or null in the first round) -> a row per block visited: cell, part, chunk, q, vector. ``dealt`` has
    the blocks and chunks of each cell; without it, rows are counts: cell, n."""

    def run(batches):
        mine = cells.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = matrix(part.column(1), part.num_rows)
                reach = part.column(2)
                _, mask = mine.first(x, k) if reach.null_count else mine.touched(x, k, reach.to_numpy())
                if dealt is None:
                    n = mask.sum(axis=0)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["cell", "n"])
                    continue
                blocks, chunks = dealt.value
                row, cell = np.nonzero(mask)
                again = blocks[cell]
                row, cell = np.repeat(row, again), np.repeat(cell, again)
                block = np.arange(len(cell)) - np.repeat(np.cumsum(again) - again, again)
                q = part.column(0).to_numpy()
                chunk = (q[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[cell]
                for a in range(0, len(row), 8192):
                    some = slice(a, a + 8192)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[some], pa.int32()), pa.array(block[some], pa.int32()), pa.array(chunk[some], pa.int32()), part.column(0).take(pa.array(row[some])), part.column(1).take(pa.array(row[some]))], names=["cell", "part", "chunk", "q", "v"])

    return run


def best(k: int, block: int = 256):
    """One block of known rows and one chunk of its visitors -> q, far (squared distance), c: k best of the block for each.

    Products of whole blocks give distances up to rounding; what they leave within reach of the k-th is measured exactly."""

    def run(known: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if known.num_rows and asking.num_rows:
            y_ids, y = known.column("c").to_numpy(), matrix(known.column("v"), known.num_rows)
            q_ids, x = asking.column("q").to_numpy(), matrix(asking.column("v"), asking.num_rows)
            size, least = (y * y).sum(axis=1), min(k, len(y_ids))
            for lo in range(0, len(q_ids), block):
                a = x[lo : lo + block]
                own = (a * a).sum(axis=1)
                rough = own[:, None] - 2 * a @ y.T + size[None]
                reach = np.partition(rough, least - 1, axis=1)[:, least - 1] + 1e-9 * (1 + size.max() + own)
                m = int((rough <= reach[:, None]).sum(axis=1).max())
                near = np.argpartition(rough, m - 1, axis=1)[:, :m]
                exact = ((y[near] - a[:, None, :]) ** 2).sum(axis=2)
                ids = y_ids[near]
                order = np.lexsort((ids, exact), axis=1)[:, :least]
                out.append((np.repeat(q_ids[lo : lo + block], least), np.take_along_axis(exact, order, 1).ravel(), np.take_along_axis(ids, order, 1).ravel()))
        cols = [np.concatenate([o[j] for o in out]) if out else np.empty(0) for j in range(3)]
        return pa.table({"q": pa.array(cols[0], pa.int64()), "far": pa.array(cols[1], pa.float64()), "c": pa.array(cols[2], pa.int64())})

    return run


def knn_join(queries: DataFrame, known: DataFrame, key: str, vector: str, k: int, report: dict | None = None) -> DataFrame:
    """Each query's k nearest known rows by Euclidean distance, then id: ``key``, rank (from 1), neighbour, distance.

    Ids are whole numbers, different in each table; a row that is in both finds itself. Rows without a vector of finite
    numbers, or without an id, take no part; a query finds fewer than k where there are fewer. Empty tables give an empty
    result. Both tables are read twice, so what is dear to compute should be written first. ``report`` gets the number of
    rows compared."""
    spark = queries.sparkSession

    def rows_of(df):
        return df.select(F.col(key).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("c").isNotNull() & usable("v"))

    every = rows_of(known)
    picked = every.select(F.xxhash64("c").alias("mark"), "c", "v").orderBy("mark", "c").limit(MOST_PIVOTS).select("v").toArrow()
    if not picked.num_rows:
        return rows_of(queries).select(F.col("c").alias(key), F.lit(1).alias("rank"), F.col("c").alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
    n = picked.num_rows if picked.num_rows < MOST_PIVOTS else every.count()
    pivots = np.unique(matrix(picked.column(0), picked.num_rows)[: math.isqrt(n)], axis=0)
    copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("c")
    few = every.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k).drop("copy")
    dealt_out = stored(few.mapInArrow(into_cells(spark.sparkContext.broadcast(pivots)), "cell int, dist double, c long, v array<double>"), "knn-cells")
    asked = rows_of(queries)
    reps = stored(asked.groupBy("v").agg(F.min("c").alias("q")).select("q", "v"), "knn-asked")
    n_asked = reps.count()
    stats = np.zeros((len(pivots), 3))
    for r in dealt_out.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect():  # a row per pivot
        stats[r.cell] = r.n, r.low, r.high
    cells = spark.sparkContext.broadcast(Cells(pivots, stats))
    blocks = np.maximum(1, -(-stats[:, 0].astype(np.int64) // BLOCK))

    def meet(asking: DataFrame, name: str) -> DataFrame:
        n_visits = np.full(len(pivots), n_asked)
        if n_asked > CHUNK or report is not None:  # else no cell can have more visitors than one chunk
            n_visits[:] = 0
            for r in asking.mapInArrow(visits(cells, k, None), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row per pivot
                n_visits[r.cell] = r.n
        chunks = np.maximum(1, -(-n_visits // CHUNK))
        if report is not None:
            report["compared"] = report.get("compared", 0) + int(n_visits @ stats[:, 0].astype(np.int64))
        of_cell = F.broadcast(spark.createDataFrame([(i, int(b), int(c)) for i, (b, c, v) in enumerate(zip(blocks, chunks, n_visits, strict=True)) if v], "cell int, blocks int, chunks int"))  # a row per pivot
        keys = ["cell", "part", "chunk"]
        left = dealt_out.join(of_cell, "cell").select("cell", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "c", "v")
        right = asking.mapInArrow(visits(cells, k, spark.sparkContext.broadcast((blocks, chunks))), "cell int, part int, chunk int, q long, v array<double>")
        return stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best(k), "q long, far double, c long"), name)

    one = meet(reps.withColumn("reach", F.lit(None).cast("double")), "knn-first")
    order = Window.partitionBy("q").orderBy("far", "c")
    kth = one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("q").agg(F.when(F.count("*") >= k, F.sqrt(F.max("far"))).otherwise(float("inf")).alias("reach"))
    two = meet(reps.join(kth, "q").select("q", "v", "reach"), "knn-second")
    top = one.union(two).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = asked.withColumnRenamed("c", "id").join(reps, "v").join(top, "q")
    return found.select(F.col("id").alias(key), "rank", F.col("c").alias("neighbour"), F.sqrt("far").alias("distance"))


def interpolate(queries: DataFrame, known: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Each query's k nearest known rows: ``confidence`` (mean similarity 1 / (1 + distance)) and ``vector`` (mean weighted by
    similarity)."""
    near = knn_join(queries, known, key, vector, k).withColumn("s", 1 / (1 + F.col("distance")))
    top = near.join(known.select(F.col(key).cast("long").alias("neighbour"), F.col(vector).cast("array<double>").alias("v")), "neighbour")
    of = top.groupBy(key).agg(F.avg("s").alias("confidence"), F.sum("s").alias("total"), F.array_sort(F.collect_list(F.struct("rank", "s", "v"))).alias("near"))  # k of them
    place = F.sequence(F.lit(0), F.size(F.col("near")[0]["v"]) - 1)
    mean = F.transform(place, lambda i: F.aggregate("near", F.lit(0.0), lambda a, x: a + x["s"] * F.get(x["v"], i)) / F.col("total"))
    return of.select(key, "confidence", mean.alias("vector"))


def density(rows: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """``key`` and 1 / (1 + mean distance of the k nearest rows, itself among them) in the space of ``columns``."""
    vectors = stored(rows.select(F.col(key).cast("long").alias(key), F.array(*(F.col(c).cast("double") for c in columns)).alias("features")), "feature-vectors")
    return knn_join(vectors, vectors, key, "features", k).groupBy(key).agg((1 / (1 + F.avg("distance"))).alias("density"))
