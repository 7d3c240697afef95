"""Ordered analytics: fills, differences, window slices, baselines, histograms, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nulls take the last value before them, within each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def window_slices(df: DataFrame, keys: list[str], order: list[str], columns: list[str], input_width: int, label_width: int, shift: int) -> DataFrame:
    """All windows of ``input_width + shift`` rows at stride 1, as ``inputs`` and ``labels`` (the last ``label_width``)."""
    total = input_width + shift
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = F.collect_list(F.struct(*columns)).over(w.rowsBetween(0, total - 1))
    out = df.withColumn("_rows", rows).where(F.size("_rows") == total)
    return out.withColumn("inputs", F.slice("_rows", 1, input_width)).withColumn("labels", F.slice("_rows", total - label_width + 1, label_width)).drop("_rows")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Counts of equal bins over [low, high]; the last bin holds its upper edge."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).alias("bin")
    return df.where(F.col(column).between(low, high)).groupBy(*(keys or []), b).agg(F.count(F.lit(1)).alias("n"))


def rating_histogram(df: DataFrame, key: str, rating: str, values: range) -> DataFrame:
    """Share of each value by key, and the most frequent value (ties: the smallest)."""
    shares = [F.avg((F.col(rating) == v).cast("double")).alias(f"share_{v}") for v in values]
    counts = [F.struct(F.sum((F.col(rating) == v).cast("long")).alias("n"), F.lit(-v).alias("minus")) for v in values]
    return df.groupBy(key).agg(*shares, (-F.array_max(F.array(*counts))["minus"]).alias("mode"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of each column, in one pass and exact quartiles."""
    made = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).alias("high")).alias(c) for c in columns]
    row = df.agg(*made).select(F.explode(F.array(*columns)).alias("d"))
    return row.select("d.column_name", "d.n", "d.mean", "d.std", "d.low", F.col("d.q")[0].alias("q1"), F.col("d.q")[1].alias("median"), F.col("d.q")[2].alias("q3"), "d.high")


def outlier_fences(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Quartiles and the box-plot fences of each key."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(q.alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[2]
    return out.select(*keys, q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"), (q1 - 1.5 * (q3 - q1)).alias("low_fence"), (q3 + 1.5 * (q3 - q1)).alias("high_fence"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and row shares of each (truth, predicted) pair."""
    n = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def chronological_split(order: Column, low: Column, high: Column, train: float = 0.7, valid: float = 0.2) -> Column:
    """Split name by the position of a time between the first and the last."""
    at = (order - low) / (high - low)
    return F.when(at < train, "train").when(at < train + valid, "valid").otherwise("test")
