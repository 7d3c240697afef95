"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard draws a hash of (key, shard) as a uniform number u and bids ``-weight / ln(u)``; the highest bid takes the
record (ties: the smaller shard). A record's shard depends on its key and the shards alone, and a further shard takes
records only into itself: on average its weight's share of them.

Defined results: a null key is one key of its own; a null text has no bytes (size 16, CRC-32 0); equal rows get
different slots; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.scratch import Scratch
from tarnfold.llm.slots import BUCKET_ROWS, running_totals

SHARDS = 40
OVERHEAD = 16
SEED = 7919


def bids(key: Column, weights: list[float]) -> Column:
    """One (bid, -shard) struct for each shard."""
    w = F.array(*[F.lit(float(x)) for x in weights])

    def bid(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), key, s), 11).cast("double") + 0.5) / F.lit(2.0**53)
        return F.struct((-F.element_at(w, s + 1) / F.log(u)).alias("bid"), (-s).alias("minus"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), bid)


def winner(found: Column, shards: int) -> Column:
    return (-F.array_max(F.slice(found, 1, shards))["minus"]).cast("int")


def assign(df: DataFrame, key: str, weights: list[float], out: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Adds the shard of each row, and in ``grown`` the shard it would have with one more shard of ``grown_weight``."""
    n = len(weights)
    made = df.withColumn("_bids", bids(F.col(key), [*weights, grown_weight]))
    made = made.withColumn(out, winner(F.col("_bids"), n))
    if grown:
        made = made.withColumn(grown, winner(F.col("_bids"), n + 1))
    return made.drop("_bids")


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; slots count from 0 in each shard."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = scratch.table(assign(rows, "doc_id", [1.0] * shards, grown="grown_shard").withColumn("_h", F.xxhash64("doc_id", "text_crc32", "size")), "rows")
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets)))
    placed = running_totals(rows, ["shard"], "_bucket", ["_h", "doc_id", "text_crc32"], F.lit(1), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
