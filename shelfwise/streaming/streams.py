"""Streams: scoring, hourly failures, running quality counts and url dedup, each with bounded state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.files import scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    glob = f"{name}.parquet"
    folder = spark.read.parquet(f"{sf_dir}/{name}.parquet").inputFiles()
    one = len(folder) == 1 and folder[0].endswith(glob)
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", glob).parquet(sf_dir) if one else reader.parquet(f"{sf_dir}/{name}.parquet")


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Process what is there and return the sink's rows as a table in the shared folder."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "stream-state")).queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_arrivals(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tables that arrive one after another in one folder; after each, the stream ``build(source)`` goes on from its
    checkpoint in append mode, so windows come out as the watermark passes them and state goes with them. Returns all that
    came out. A batch that is run again replaces its own output."""
    spark = parts[0].sparkSession
    source, sink, state = scratch(spark, "arrivals"), scratch(spark, "stream"), scratch(spark, "stream-state")
    schema = parts[0].schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    for part in parts:
        part.write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", state).queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink).select(stream.columns)


def by_arrival(events: DataFrame, ts: str, late: Column) -> list[DataFrame]:
    """Events in three arrivals by thirds of their time; of the first third, the ``late`` ones come with the last arrival."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [events]
    third = (high - low) // 3
    part = F.when(late & (at < low + third), 2).when(at < low + third, 0).when(at < low + 2 * third, 1).otherwise(2)
    return [events.filter(part == k) for k in range(3)]


def hourly_failures(events: DataFrame, watermark: str | None = "1 hour") -> DataFrame:
    """(ts, event_type) -> hour and failures of each tumbling hour; late rows beyond the watermark are dropped in append mode."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("event_type = 'error'")
    e = e.withWatermark("ts", watermark) if watermark else e
    return e.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("failures")).select(F.col("window.start").alias("hour"), "failures")


def sliding_quality(events: DataFrame, low: float, high: float) -> DataFrame:
    """Rows, values under ``low`` and values over ``high`` in every hour, each quarter of an hour."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    w = e.groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < low).alias("low"), F.count_if(F.col("value") > high).alias("high"))
    return w.select(F.col("window.start").alias("start"), "n", "low", "high")


def first_urls(urls: DataFrame, ts: str, within: str = "1 hour") -> DataFrame:
    """Rows whose url_hash was not seen within the watermark."""
    return urls.withWatermark(ts, within).dropDuplicatesWithinWatermark(["url_hash"])
