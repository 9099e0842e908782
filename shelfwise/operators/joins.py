"""Joins, reconciliation and gaps as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def reconcile(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """One row: ids missing from and extra in ``given``, common ids, coverage, exact match, difference of row counts."""
    a = expected.groupBy(key).agg(F.count("*").alias("na"))
    b = given.groupBy(key).agg(F.count("*").alias("nb"))
    x, y = F.col("na").isNotNull(), F.col("nb").isNotNull()
    return a.join(b, key, "full_outer").agg(
        F.count_if(~y).alias("missing"),
        F.count_if(~x).alias("extra"),
        F.count_if(x & y).alias("common"),
        (100.0 * F.count_if(x & y) / F.count_if(x)).alias("coverage"),
        (F.count_if(~x | ~y) == 0).alias("exact"),
        (F.coalesce(F.sum("nb"), F.lit(0)) - F.coalesce(F.sum("na"), F.lit(0))).alias("row_difference"),
    )


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, expected) against (path, actual): valid, mismatch or missing; paths that nobody expects are orphans."""
    j = expected.join(actual, "path", "full_outer")
    state = F.when(F.col("expected").isNull(), "orphan").when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("expected"), "valid").otherwise("mismatch")
    return j.select("path", state.alias("state"))


def inverse_weights(scores: DataFrame, column: str) -> DataFrame:
    """Weights in proportion to 1 / score; a row per model."""
    inverse = 1 / F.col(column)
    return scores.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy()))


def gaps(df: DataFrame, column: str) -> DataFrame:
    """Consecutive differences of the sorted values of ``column`` (nulls left out), as ``gap``.

    Partitions hold ranges, so only one value per partition, its largest, crosses a partition border."""
    spread = df.select(F.col(column).cast("double").alias("v")).filter("v is not null").repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id())
    ends = spread.groupBy("part").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    across = ends.select((F.col("low") - F.lag("high").over(Window.orderBy("part"))).alias("gap"))  # one row per partition
    inside = spread.select((F.col("v") - F.lag("v").over(Window.partitionBy("part").orderBy("v"))).alias("gap"))
    return inside.union(across).filter("gap is not null")
