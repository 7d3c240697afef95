"""Time series and ordered analytics over events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold import functions as fn
from tarnfold import sources as S
from tarnfold.operators import ordered as O
from tarnfold.operators import relational as R
from tarnfold.plans.registry import query
from tarnfold.plans.relational import RATINGS, ratings

HOURLY = "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, avg(value) AS v, count(*) AS n FROM events GROUP BY 1"


def hourly(spark, sf) -> DataFrame:
    """One row an hour: the table that stands for a series; a window over it has as many rows as hours."""
    return S.table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))


def by_time():
    return Window.orderBy("hour")


@query("WITH m AS (SELECT c_nationkey AS nation, median(c_acctbal) AS med FROM customer GROUP BY 1) SELECT nation, round(med, 4) AS med, round(coalesce(lead(med) OVER (ORDER BY nation) - med, 0), 4) AS step FROM m")
def median_by_group_diff(spark, sf):
    m = S.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.median("c_acctbal").alias("med"))
    step = F.coalesce(F.lead("med").over(Window.orderBy("nation")) - F.col("med"), F.lit(0.0))
    return m.select("nation", F.round("med", 4).alias("med"), F.round(step, 4).alias("step"))


@query("WITH m AS (SELECT c_mktsegment AS segment, c_nationkey, median(c_acctbal) AS med FROM customer GROUP BY 1, 2) SELECT segment, round(avg(med), 4) AS mean_of_medians FROM m GROUP BY 1")
def mean_of_medians(spark, sf):
    m = S.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment"), "c_nationkey").agg(F.median("c_acctbal").alias("med"))
    return m.groupBy("segment").agg(F.round(F.avg("med"), 4).alias("mean_of_medians"))


@query("WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events) SELECT user_id, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM e")
def forward_fill(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return O.forward_fill(e, ["user_id"], ["event_id"], ["v"])


@query("""WITH w AS (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS l FROM events)
SELECT user_id, event_id, round(list_sum(l[1:6]), 4) AS inputs, round(l[7], 4) AS label FROM w WHERE len(l) = 7""")
def window_slices(spark, sf):
    w = O.window_slices(S.table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], ["value"], 6, 1, 1)
    total = F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x["value"])
    return w.select("user_id", "event_id", F.round(total, 4).alias("inputs"), F.round(F.col("labels")[0]["value"], 4).alias("label"))


@query(f"SELECT round(avg(abs(v - p)), 6) AS mae, count(*) AS n FROM (SELECT v, lag(v) OVER (ORDER BY hour) AS p FROM ({HOURLY})) WHERE p IS NOT NULL")
def persistence_mae(spark, sf):
    p = hourly(spark, sf).withColumn("p", F.lag("v").over(by_time()))
    return p.where("p IS NOT NULL").agg(F.round(F.avg(F.abs(F.col("v") - F.col("p"))), 6).alias("mae"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH h AS ({HOURLY}), l AS ({" UNION ALL ".join(f"SELECT {k}::INTEGER AS horizon, v, lag(v, {k}) OVER (ORDER BY hour) AS p FROM h" for k in (1, 6, 24))})
SELECT horizon, round(avg(abs(v - p)), 6) AS mae FROM l WHERE p IS NOT NULL GROUP BY 1""")
def last_value_by_horizon(spark, sf):
    h = hourly(spark, sf).select("v", *[F.lag("v", k).over(by_time()).alias(f"p{k}") for k in (1, 6, 24)])
    each = h.select("v", F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.col(f"p{k}").alias("p")) for k in (1, 6, 24)])).alias("x")).where("x.p IS NOT NULL")
    return each.groupBy("x.horizon").agg(F.round(F.avg(F.abs(F.col("v") - F.col("x.p"))), 6).alias("mae"))


@query(f"SELECT round(avg(abs(v - p)), 6) AS mae FROM (SELECT v, lag(v, 24) OVER (ORDER BY hour) AS p FROM ({HOURLY})) WHERE p IS NOT NULL")
def repeat_baseline_mae(spark, sf):
    p = hourly(spark, sf).withColumn("p", F.lag("v", 24).over(by_time()))
    return p.where("p IS NOT NULL").agg(F.round(F.avg(F.abs(F.col("v") - F.col("p"))), 6).alias("mae"))


@query(f"""WITH r AS ({RATINGS}), c AS (SELECT user_id, rating, count(*) AS n FROM r GROUP BY 1, 2), m AS (SELECT user_id, arg_max(rating, (n, -rating))::INTEGER AS mode FROM c GROUP BY 1)
SELECT user_id, {", ".join(f"round(avg(CASE WHEN rating = {k} THEN 1.0 ELSE 0 END), 6) AS share_{k}" for k in range(1, 6))}, any_value(mode) AS mode FROM r JOIN m USING (user_id) GROUP BY 1""")
def rating_histogram_mode(spark, sf):
    h = O.rating_histogram(ratings(spark, sf), "user_id", "rating", range(1, 6))
    return h.select("user_id", *[F.round(f"share_{k}", 6).alias(f"share_{k}") for k in range(1, 6)], "mode")


@query("SELECT least(floor((l_quantity - 1) / 4.9), 9)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")
def histogram_bins(spark, sf):
    return O.histogram(S.table(spark, sf, "lineitem"), "l_quantity", 1.0, 50.0, 10)


@query("SELECT least(floor(l_quantity / 5.0), 9)::BIGINT AS x, least(floor(l_discount / 0.02), 5)::BIGINT AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_2d(spark, sf):
    x, y = F.least(F.floor(F.col("l_quantity") / 5.0), F.lit(9)), F.least(F.floor(F.col("l_discount") / 0.02), F.lit(5))
    return S.table(spark, sf, "lineitem").groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(q[1], 3) AS q1, round(q[2], 3) AS median, round(q[3], 3) AS q3, round(q[1] - 1.5 * (q[3] - q[1]), 3) AS low_fence, round(q[3] + 1.5 * (q[3] - q[1]), 3) AS high_fence FROM q""")
def quartiles_fences(spark, sf):
    f = O.outlier_fences(S.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return f.select("l_returnflag", *[F.round(c, 3).alias(c) for c in ("q1", "median", "q3", "low_fence", "high_fence")])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS low, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS high FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_stats(spark, sf):
    d = O.describe(S.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return d.select("column_name", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "low", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "high")


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 5) AS z_sample, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 5) AS z_population FROM supplier")
def zscore_pop_samp(spark, sf):
    """Mean and deviations are one aggregated row that joins back, so the table itself is not gathered in one window."""
    s = S.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    m = s.agg(F.avg("s_acctbal").alias("m"), F.stddev_samp("s_acctbal").alias("a"), F.stddev_pop("s_acctbal").alias("b"))
    z = s.join(F.broadcast(m))
    return z.select("s_suppkey", F.round((F.col("s_acctbal") - F.col("m")) / F.col("a"), 5).alias("z_sample"), F.round((F.col("s_acctbal") - F.col("m")) / F.col("b"), 5).alias("z_population"))


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_melt(spark, sf):
    p = S.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return R.unpivot(p, ["p_partkey"], ["p_size", "p_retailprice"])


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::INTEGER AS c_mktsegment_{v}" for v in _SEGMENTS[1:]) + " FROM customer")
def one_hot_dropfirst(spark, sf):
    return R.one_hot(S.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", _SEGMENTS).drop("c_mktsegment")


@query("WITH e AS (SELECT event_id, floor(epoch(ts)) AS s FROM events) SELECT event_id, round(sin(s * (2 * pi() / 86400)), 4) + 0.0::DOUBLE AS day_sin, round(cos(s * (2 * pi() / 86400)), 4) + 0.0::DOUBLE AS day_cos, round(sin(s * (2 * pi() / 31556952.0)), 4) + 0.0::DOUBLE AS year_sin, round(cos(s * (2 * pi() / 31556952.0)), 4) + 0.0::DOUBLE AS year_cos FROM e")
def cyclic_time_features(spark, sf):
    e = S.table(spark, sf, "events")
    return e.select("event_id", *[(F.round(c, 4) + F.lit(0.0)).alias(n) for n, c in fn.cyclic(F.col("ts")).items()])


@query("SELECT event_id, round(value * cos(radians(user_id % 360)), 5) AS wx, round(value * sin(radians(user_id % 360)), 5) AS wy FROM events")
def wind_components(spark, sf):
    x, y = fn.wind(F.col("value"), F.col("user_id") % 360)
    return S.table(spark, sf, "events").select("event_id", F.round(x, 5).alias("wx"), F.round(y, 5).alias("wy"))


@query("WITH p AS (SELECT l_returnflag AS truth, CASE WHEN l_quantity > 25 THEN 'A' WHEN l_discount > 0.05 THEN 'N' ELSE 'R' END AS predicted FROM lineitem) SELECT truth, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM p GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    p = F.when(F.col("l_quantity") > 25, "A").when(F.col("l_discount") > 0.05, "N").otherwise("R")
    c = O.confusion(S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("truth"), p.alias("predicted")), "truth", "predicted")
    return c.withColumn("share", F.round("share", 6))


@query("WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events) SELECT CASE WHEN (event_id - lo) / (hi - lo) < 0.7 THEN 'train' WHEN (event_id - lo) / (hi - lo) < 0.7 + 0.2 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, round(avg(value), 6) AS mean FROM events, b GROUP BY 1")
def chronological_split(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", "value")
    b = e.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    split = O.chronological_split(F.col("event_id"), F.col("lo"), F.col("hi"))
    return e.join(F.broadcast(b)).groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS position FROM events")
def running_position(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return S.table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("position"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity - lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS change FROM lineitem")
def lag_difference(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    line = S.table(spark, sf, "lineitem")
    return line.select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_quantity") - F.lag("l_quantity").over(w)).alias("change"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, (SELECT max(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate AND p.o_orderdate >= o.o_orderdate - INTERVAL 365 DAY) AS best_last_year FROM orders o")
def range_window_max(spark, sf):
    """A range frame over days: what an interval self-join would give, with one shuffle."""
    o = S.table(spark, sf, "orders")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    w = Window.partitionBy("o_custkey").orderBy(day).rangeBetween(-365, -1)
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.max("o_totalprice").over(w).alias("best_last_year"))
