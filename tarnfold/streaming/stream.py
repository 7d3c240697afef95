"""Streams of events: they work on batch frames alike, so a batch run checks a stream's plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators.relational import with_index
from tarnfold.sources import Workspace

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, sf_dir: str, delay: str = "10 minutes") -> DataFrame:
    """The events table as a stream, event time with a watermark."""
    raw = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def drain(df: DataFrame, work: Workspace, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, into files, and reads the result."""
    path, schema = work.path(name), df.schema
    started = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", work.path(f"{name}-log")).trigger(availableNow=True).start()
    started.awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(path)


def sessions(df: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """Count and span of each session: events of a key with no gap between them."""
    made = df.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sliding(df: DataFrame, size: str, step: str, keys: list[str]) -> DataFrame:
    made = df.groupBy(F.window("ts", size, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return made.select(F.col("w.start").alias("start"), *keys, "n", "mean")


def unique_within(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key; on a stream state older than the watermark is dropped."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def draws(lines: DataFrame, order: str, value: str, requests: DataFrame, work: Workspace, seed: int = 1) -> DataFrame:
    """``draw, value``: for every id of ``requests`` (a range, or a stream such as the rate source) a uniform draw with
    replacement from the lines, which are numbered by ``order``; the same id gives the same line.

    Lines and draws meet by line number, so neither side is gathered. No lines, no draws.
    """
    numbered = work.table(with_index(lines.select(order, value), [F.col(order)], work, "lines", "_line"), "numbered")
    count = max(numbered.count(), 1)
    at = F.pmod(F.pmod((F.col("id") + seed) * F.lit(2654435761) + F.lit(12345), F.lit(4294967291)), F.lit(count))
    return requests.select(F.col("id").alias("draw"), at.alias("_at")).join(numbered, F.col("_at") == F.col("_line")).select("draw", F.col(value).alias("value"))
