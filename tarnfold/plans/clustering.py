"""Clusters of embeddings."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tarnfold import sources as S
from tarnfold.operators import clustering as C
from tarnfold.plans.registry import query

_EACH = "SELECT label::BIGINT AS cluster, vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"
_STATS = f"SELECT cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM ({_EACH}) GROUP BY 1, 2"


def points(spark, sf):
    return S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("features"))


@query(f"SELECT cluster, dim::INTEGER AS dim, n, round(s, 4) AS total, round(q, 4) AS squares FROM ({_STATS})")
def cluster_sufficient_stats(spark, sf):
    s = C.statistics(points(spark, sf), "label")
    each = s.select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "x"))
    return each.select("cluster", "dim", "n", F.round("x.sum", 4).alias("total"), F.round("x.sumsq", 4).alias("squares"))


@query(f"WITH c AS (SELECT cluster, dim, s / n AS m, greatest(q / n - power(s / n, 2), 1e-9) AS v FROM ({_STATS})), d AS (SELECT vec_id, c.cluster, sqrt(sum(power(x - m, 2) / v)) AS d FROM ({_EACH}) p JOIN c USING (dim) GROUP BY 1, 2) SELECT vec_id AS id, arg_min(cluster, d) AS cluster, round(min(d), 4) AS distance FROM d GROUP BY 1")
def mahalanobis_nearest(spark, sf):
    p = points(spark, sf)
    found = C.nearest(p.select("id", "features"), C.centres(C.statistics(p, "label")))
    return found.select("id", "cluster", F.round("distance", 4).alias("distance"))


@query(f"WITH c AS (SELECT cluster, dim, s / n AS m, greatest(q / n - power(s / n, 2), 1e-9) AS v FROM ({_STATS})) SELECT x.cluster AS a, y.cluster AS b, round(sqrt(sum(power(x.m - y.m, 2) / y.v)), 4) AS distance FROM c x JOIN c y ON x.dim = y.dim AND x.cluster < y.cluster GROUP BY 1, 2 HAVING sqrt(sum(power(x.m - y.m, 2) / y.v)) < 2 * sqrt(64)")
def centroid_merge_pairs(spark, sf):
    return C.close_pairs(C.centres(C.statistics(points(spark, sf), "label")), 2.0).withColumn("distance", F.round("distance", 4))


@query("WITH n AS (SELECT vec_id % 7 AS cluster, label, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT cluster, arg_max(label, (n, -label))::BIGINT AS majority_label, round(max(n) / sum(n), 6) AS share FROM n GROUP BY 1")
def majority_label(spark, sf):
    p = points(spark, sf).withColumn("cluster", F.col("id") % 7)
    return C.majority(p, "cluster", "label").withColumn("share", F.round("share", 6))


@query(f"SELECT a.dim::INTEGER AS i, b.dim::INTEGER AS j, round(covar_samp(a.x, b.x), 7) + 0.0::DOUBLE AS covariance FROM ({_EACH}) a JOIN ({_EACH}) b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2")
def pca_covariance(spark, sf):
    """Covariances of all dimensions: pairs of a row's values, summed before the shuffle."""
    each = points(spark, sf).select("features", F.posexplode("features").alias("i", "x"))
    pairs = each.select("i", "x", F.posexplode("features").alias("j", "y")).where("i <= j")
    return pairs.groupBy("i", "j").agg((F.round(F.covar_samp("x", "y"), 7) + F.lit(0.0)).alias("covariance"))


@query()
def pca_two_components(spark, sf):
    """Centred first, so the components match a centring library."""
    p = points(spark, sf)
    n = len(p.first()["features"])
    means = p.agg(F.array(*[F.avg(F.col("features")[i]) for i in range(n)]).alias("means"))
    centred = p.join(F.broadcast(means)).select("id", array_to_vector(F.zip_with("features", "means", lambda a, b: a - b)).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="pc").fit(centred).transform(centred)
    return out.select("id", vector_to_array("pc")[0].alias("pc1"), vector_to_array("pc")[1].alias("pc2"))


@query()
def kmeans_silhouette(spark, sf):
    """Silhouette for k = 2..10, by squared Euclidean distances: those need sums by cluster, plain ones all pairs of points."""
    p = S.Workspace(spark, "kmeans").table(points(spark, sf).select("id", "features"), "points").select("id", array_to_vector("features").alias("features"))
    rows = []
    for k in range(2, 11):
        made = KMeans(k=k, seed=1).fit(p).transform(p)
        rows.append((k, float(ClusteringEvaluator().evaluate(made))))
    return spark.createDataFrame(rows, "k int, silhouette double")


@query()
def kmeans_similar_set(spark, sf):
    """Members of the cluster that a probe (the first vector) falls into."""
    p = points(spark, sf).select("id", array_to_vector("features").alias("features"))
    model = KMeans(k=5, seed=1).fit(p)
    home = model.predict(p.where("id = 0").first()["features"])
    return model.transform(p).where(F.col("prediction") == home).select("id", "prediction")


@query()
def bfr(spark, sf):
    p = points(spark, sf)
    work = S.Workspace(spark, "bfr")
    found, _ = C.bfr(p.select("id", "features"), work)
    found = work.table(found, "found")
    named = C.majority(found.join(p.select("id", "label"), "id"), "cluster", "label")
    return found.join(F.broadcast(named), "cluster", "left").select("id", F.col("cluster").alias("cluster_id"), "majority_label")


@query()
def bfr_rounds(spark, sf):
    """Points in clusters, in compressed sets and retained, after each round."""
    _, counts = C.bfr(points(spark, sf).select("id", "features"), S.Workspace(spark, "bfr"))
    return spark.createDataFrame(counts, "round int, discarded bigint, compressed bigint, retained bigint")
