"""Running totals inside groups of any size: a group is cut into buckets, only a bucket's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 8192


def hex_bucket(digest: Column, buckets: int) -> Column:
    """Bucket of a hexadecimal digest; it grows with the digest, so that buckets stand in the digests' order."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2.0**32)).cast("int")


def running_totals(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: Column, out: str = "before") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that stand earlier, by bucket and then ``order``.

    Null groups count as one group. ``df`` is read twice, so it should be a table.
    """
    keys = [*groups, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [ranked[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return ranked.join(starts, on).withColumn(out, F.col("_start") + F.col("_within")).drop("_start", "_within", *[f"_k_{k}" for k in keys])
