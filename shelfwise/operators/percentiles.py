"""Exact linear percentiles and ranks that stay distributed however many different values there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
CELLS = 3  # hexadecimal digits of a hash


def percentiles(df: DataFrame, column: str | Column, shares: tuple[float, ...] | list[float], name: str = "percentiles", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (one per group of ``by``) with ``name``: the linear percentiles of ``column`` at ``shares``, nulls left out.

    A sketch (partial aggregates of bounded size) brackets each percentile by two values whose ranks are off by at most 3
    in ``ACCURACY``. One more pass counts the rows below, in and above each bracket, those in it by value, all summed
    before the shuffle; the values at the two neighbouring ranks are then read off the running count. What one task sorts
    is the different values of one bracket: those of 0.04 % of the rows at most. Without values the percentiles are null."""
    v = F.col(column) if isinstance(column, str) else column
    rows = df.select(*by, v.cast("double").alias("v")).filter("v is not null")
    near = [min(1.0, max(0.0, s + e)) for s in shares for e in (-2 / ACCURACY, 2 / ACCURACY)]
    sketch = F.percentile_approx("v", F.array(*(F.lit(x) for x in near)), ACCURACY).alias("edges")
    bounds = rows.groupBy(*by).agg(sketch, F.count("v").alias("total"))
    joined = rows.join(F.broadcast(bounds), list(by)) if by else rows.join(F.broadcast(bounds), F.lit(True))  # a row per group
    places = []
    for i in range(len(shares)):
        low, high = F.col("edges")[2 * i], F.col("edges")[2 * i + 1]
        side = F.when(F.col("v") < low, -1).when(F.col("v") > high, 1).otherwise(0)
        places.append(F.struct(F.lit(i).alias("i"), side.alias("side"), F.when(side == 0, F.col("v")).alias("at")))
    split = joined.select(*by, "total", "v", F.explode(F.array(*places)).alias("p"))
    # the nearest value below a bracket and the nearest above it stand for all rows there
    counted = split.groupBy(*by, "p.i", "p.side", "p.at").agg(F.count("*").alias("n"), F.max("v").alias("most"), F.min("v").alias("least"), F.first("total").alias("total"))
    counted = counted.withColumn("value", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")))
    running = F.sum("n").over(Window.partitionBy(*by, "i").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    share = F.element_at(F.array(*(F.lit(float(s)) for s in shares)), F.col("i") + 1)
    rank = counted.withColumn("upto", running).withColumn("rank", share * (F.col("total") - 1))
    two = rank.groupBy(*by, "i").agg(F.min(F.when(F.col("upto") > F.floor("rank"), F.col("value"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("value"))).alias("b"), F.first(F.col("rank") - F.floor("rank")).alias("part"))
    found = two.select(*by, "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"])
    return found.groupBy(*by).agg(ordered.alias(name)) if by else found.agg(F.when(F.count("*") > 0, ordered).otherwise(F.array(*[F.lit(None).cast("double")] * len(shares))).alias(name))


def percentiles_of(df: DataFrame, columns: list[str], shares: tuple[float, ...] | list[float], prefix: str) -> DataFrame:
    """One row with ``percentiles`` of each column under prefix + column: one sketch and one counting pass for all."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x"))
    each = percentiles(long.select("x.c", "x.v"), "v", shares, "e", ("c",))  # a row per column
    nothing = F.array(*[F.lit(None).cast("double")] * len(shares))
    return each.agg(*(F.coalesce(F.max(F.when(F.col("c") == c, F.col("e"))), nothing).alias(f"{prefix}{c}") for c in columns))


def beside(row: DataFrame, more: DataFrame) -> DataFrame:
    """Two tables of one row side by side."""
    return row.join(F.broadcast(more), F.lit(True))


def hashed_rank(df: DataFrame, group: str, key: str) -> DataFrame:
    """``df`` with ``place`` (rank from 0 by the md5 of ``key`` within ``group``) and ``members`` (rows of the group).

    A hash is uniform, so its first digits cut each group into cells of about equal size without sampling: rows are ranked
    within their cell, and the sizes of the cells before it, a small table, are added."""
    hashed = df.withColumn("hash", F.md5(F.col(key).cast("string"))).withColumn("cell", F.substring("hash", 1, CELLS))
    sizes = hashed.groupBy(group, "cell").agg(F.count("*").alias("n"))  # at most 16^CELLS rows a group
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("members"))
    inside = F.rank().over(Window.partitionBy(group, "cell").orderBy("hash")) - 1
    return hashed.withColumn("inside", inside).join(offsets, [group, "cell"]).withColumn("place", F.col("before") + F.col("inside")).drop("hash", "cell", "inside", "before")
