"""Cluster statistics and clustering in chunks (Bradley, Fayyad, Reina)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.graph import components
from tarnfold.sources import Workspace

VARIANCE_FLOOR = 1e-9


def statistics(points: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """``cluster, n, sum, sumsq`` (arrays by dimension), summed by (cluster, dimension) with partial sums."""
    each = points.select(F.col(cluster).alias("cluster"), F.posexplode(features).alias("dim", "x"))
    per = each.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    row = per.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("d"))
    return row.select("cluster", "n", F.transform("d", lambda x: x["s"]).alias("sum"), F.transform("d", lambda x: x["q"]).alias("sumsq"))


def centres(stats: DataFrame) -> DataFrame:
    """``cluster, centre, variance``; variances have a floor."""
    centre = F.transform("sum", lambda s: s / F.col("n"))
    variance = F.zip_with("sum", "sumsq", lambda s, q: F.greatest(q / F.col("n") - F.pow(s / F.col("n"), 2), F.lit(VARIANCE_FLOOR)))
    return stats.select("cluster", "n", centre.alias("centre"), variance.alias("variance"))


def mahalanobis(x, centre, variance):
    """Diagonal Mahalanobis distance of two array columns."""
    parts = F.zip_with(F.zip_with(x, centre, lambda a, b: F.pow(a - b, 2)), variance, lambda d, v: d / v)
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))


def nearest(points: DataFrame, held: DataFrame) -> DataFrame:
    """Points with ``cluster`` and ``distance`` of the nearest centre (ties: the smaller cluster).

    ``held`` has one row a cluster, a parameter of the method, so it is joined to every point as one array.
    """
    listed = held.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre", "variance"))).alias("held"))
    each = F.transform("held", lambda c: F.struct(mahalanobis(F.col("features"), c["centre"], c["variance"]).alias("distance"), c["cluster"].alias("cluster")))
    found = points.join(F.broadcast(listed)).withColumn("_best", F.array_min(each)).drop("held")
    return found.withColumn("cluster", F.col("_best.cluster")).withColumn("distance", F.col("_best.distance")).drop("_best")


def close_pairs(held: DataFrame, radius: float) -> DataFrame:
    """``a, b, distance`` of clusters nearer than ``radius`` times the root of the dimension."""
    x = held.select(F.col("cluster").alias("a"), F.col("centre").alias("ca"), F.col("variance").alias("va"))
    y = held.select(F.col("cluster").alias("b"), F.col("centre").alias("cb"), F.col("variance").alias("vb"))
    near = x.join(y, F.col("a") < F.col("b")).withColumn("distance", mahalanobis(F.col("ca"), F.col("cb"), F.col("vb")))
    return near.where(F.col("distance") < radius * F.sqrt(F.size("ca"))).select("a", "b", "distance")


def majority(points: DataFrame, cluster: str, label: str) -> DataFrame:
    """``cluster, label, share``: most frequent label of each cluster (ties: the smallest label)."""
    n = points.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.col(cluster).alias("cluster")).agg(F.max_by(F.col(label), F.struct("n", -F.col(label))).alias("majority_label"), (F.max("n") / F.sum("n")).alias("share"))


def _kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    return KMeans(k=k, seed=seed, maxIter=20, predictionCol="cluster").fit(points.withColumn("_v", array_to_vector("features")).withColumnRenamed("_v", "features_vector").drop("features").withColumnRenamed("features_vector", "features")).transform(points.select("id", F.col("features").alias("_f"), array_to_vector("features").alias("features"))).select("id", F.col("_f").alias("features"), "cluster")


def bfr(points: DataFrame, work: Workspace, k: int = 10, chunks: int = 5, radius: float = 2.0, seed: int = 42) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """``id, cluster`` (-1: retained) and (round, in clusters, in compressed sets, retained) counts.

    ``points``: id, features (doubles). The first chunk is clustered with many centres, single points are set aside and
    k clusters are drawn from the rest; later chunks go to the nearest cluster within the radius, else to the nearest
    compressed set, else are retained and clustered again. A chunk's points are admitted against the statistics before
    it. At the end compressed sets join the nearest cluster within the radius.
    """
    chunked = work.table(points.withColumn("chunk", F.pmod(F.col("id"), F.lit(chunks))), "points")
    first = _kmeans(chunked.where("chunk = 0"), 5 * k, seed)
    sizes = first.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    first = work.table(first.join(sizes, "cluster"), "first")
    discard = work.table(_kmeans(first.where("members > 1").select("id", "features"), k, seed).withColumn("cluster", F.col("cluster").cast("long")), "ds-0")
    rest = work.table(first.where("members = 1").select("id", "features"), "rest-0")
    compressed = work.table(discard.limit(0), "cs-0")
    counts = []
    limit = radius * F.sqrt(F.size("features"))
    for c in range(chunks):
        if c:
            chunk = chunked.where(F.col("chunk") == c).select("id", "features")
            placed = work.table(nearest(chunk, centres(statistics(discard))).withColumn("_in", F.col("distance") < limit), f"placed-{c}")
            discard = work.table(discard.unionByName(placed.where("_in").select("id", "features", "cluster")), f"ds-{c}")
            left = placed.where("not _in").select("id", "features")
            if not compressed.isEmpty():
                held = centres(statistics(compressed))
                tried = work.table(nearest(left, held).withColumn("_in", F.col("distance") < limit), f"tried-{c}")
                compressed = work.table(compressed.unionByName(tried.where("_in").select("id", "features", "cluster")), f"cs-grown-{c}")
                left = tried.where("not _in").select("id", "features")
            rest = work.table(rest.unionByName(left), f"rest-{c}")
        n = rest.count()
        if n > 5 * k:
            again = _kmeans(rest, min(5 * k, n), seed + c)
            sizes = again.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
            again = work.table(again.join(sizes, "cluster"), f"again-{c}")
            base = 1000 * (c + 1)
            grown = again.where("members > 1").select("id", "features", (F.col("cluster") + base).cast("long").alias("cluster"))
            compressed = work.table(compressed.unionByName(grown), f"cs-{c + 1}")
            rest = work.table(again.where("members = 1").select("id", "features"), f"rest-kept-{c}")
            pairs = work.table(close_pairs(centres(statistics(compressed)), radius).select(F.col("a").alias("src"), F.col("b").alias("dst")), f"close-{c}")
            if not pairs.isEmpty():
                merged = components(pairs, work, f"merge-{c}")
                compressed = work.table(compressed.join(F.broadcast(merged), F.col("cluster") == F.col("node"), "left").select("id", "features", F.coalesce("component", "cluster").alias("cluster")), f"cs-merged-{c}")
        counts.append((c, discard.count(), compressed.count(), rest.count()))
    out = discard.select("id", "cluster")
    if not compressed.isEmpty():
        sets = centres(statistics(compressed)).select(F.col("cluster").alias("id"), F.col("centre").alias("features"))
        to = nearest(sets, centres(statistics(discard))).select(F.col("id").alias("_set"), F.when(F.col("distance") < limit, F.col("cluster")).otherwise(F.col("id")).alias("_to"))
        out = out.unionByName(compressed.join(F.broadcast(to), F.col("cluster") == F.col("_set")).select("id", F.col("_to").alias("cluster")))
    return out.unionByName(rest.select("id", F.lit(-1).cast("long").alias("cluster"))), counts
