"""Regression, classification, fairness and forecasting over the shared tables.

Deep networks of the workload (recurrent, convolutional, embedding layers) have no Spark counterpart: linear and tree
models stand for them, and say so here. Windows, baselines and metrics are the same.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tarnfold import functions as fn
from tarnfold import sources as S
from tarnfold.operators import statistics as T
from tarnfold.plans.registry import query

_CARS = "SELECT l_extendedprice AS price, ln(l_extendedprice) AS log_price, l_quantity AS quantity, p_retailprice AS retail, p_size::DOUBLE AS size, l_orderkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey"


def cars(spark, sf):
    line, p = S.table(spark, sf, "lineitem"), S.table(spark, sf, "part")
    j = line.join(p, line.l_partkey == p.p_partkey)
    return j.select(F.col("l_extendedprice").alias("price"), F.log("l_extendedprice").alias("log_price"), F.col("l_quantity").alias("quantity"), F.col("p_retailprice").alias("retail"), F.col("p_size").cast("double").alias("size"), F.col("l_orderkey").alias("k"))


@query(f"SELECT round(regr_slope(log_price, quantity), 6) AS slope, round(regr_intercept(log_price, quantity), 6) AS intercept, round(regr_r2(log_price, quantity), 6) AS r2, regr_count(log_price, quantity)::BIGINT AS n FROM ({_CARS})")
def ols_simple(spark, sf):
    c = cars(spark, sf)
    return c.agg(F.round(F.regr_slope("log_price", "quantity"), 6).alias("slope"), F.round(F.regr_intercept("log_price", "quantity"), 6).alias("intercept"), F.round(F.regr_r2("log_price", "quantity"), 6).alias("r2"), F.regr_count("log_price", "quantity").alias("n"))


@query()
def ols_summary(spark, sf):
    """Coefficients with standard errors, t and p values; the last row is the constant."""
    names = ["quantity", "retail", "size"]
    m = T.ols(cars(spark, sf), "log_price", names)
    s = m.summary
    rows = list(zip([*names, "const"], [*map(float, m.coefficients), float(m.intercept)], s.coefficientStandardErrors, s.tValues, s.pValues, strict=True))
    return spark.createDataFrame(rows, "term string, coefficient double, error double, t double, p double")


_VIF = "1 + 2 * q * w * e - q * q - w * w - e * e"


@query(f"WITH c AS ({_CARS}), r AS (SELECT corr(quantity, retail) AS q, corr(quantity, size) AS w, corr(retail, size) AS e FROM c) SELECT 'quantity' AS column_name, round((1 - e * e) / ({_VIF}), 6) AS vif FROM r UNION ALL SELECT 'retail', round((1 - w * w) / ({_VIF}), 6) FROM r UNION ALL SELECT 'size', round((1 - q * q) / ({_VIF}), 6) FROM r")
def variance_inflation(spark, sf):
    """In SQL the diagonal of the inverse of the correlation matrix."""
    made = spark.createDataFrame(T.vif(cars(spark, sf), ["quantity", "retail", "size"]), "column_name string, vif double")
    return made.withColumn("vif", F.round("vif", 6))


@query(f"WITH c AS ({_CARS}), m AS (SELECT var_pop(quantity) AS a, var_pop(retail) AS b, covar_pop(quantity, retail) AS ab, covar_pop(quantity, log_price) AS ay, covar_pop(retail, log_price) AS by_, stddev_samp(quantity) AS sa, stddev_samp(retail) AS sb, stddev_samp(log_price) AS sy FROM c), w AS (SELECT *, (b * ay - ab * by_) / (a * b - ab * ab) AS wa, (a * by_ - ab * ay) / (a * b - ab * ab) AS wb FROM m) SELECT 'quantity' AS column_name, round(wa, 6) AS coefficient, round(abs(wa) * sa / sy, 6) AS importance FROM w UNION ALL SELECT 'retail', round(wb, 6), round(abs(wb) * sb / sy, 6) FROM w")
def coefficient_importance(spark, sf):
    rows = T.importance(cars(spark, sf), "log_price", ["quantity", "retail"])
    made = spark.createDataFrame(rows, "column_name string, coefficient double, importance double")
    return made.select("column_name", F.round("coefficient", 6).alias("coefficient"), F.round("importance", 6).alias("importance"))


_GUESS = "SELECT l_returnflag AS truth, CASE WHEN l_quantity > 25 THEN 'A' WHEN l_discount > 0.05 THEN 'N' ELSE 'R' END AS predicted FROM lineitem"


@query(f"WITH p AS ({_GUESS}), l AS (SELECT DISTINCT truth AS label FROM p UNION SELECT DISTINCT predicted FROM p), s AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label) AS support, (SELECT count(*) FROM p WHERE predicted = label) AS called, (SELECT count(*) FROM p WHERE truth = label AND predicted = label) AS hit FROM l), a AS (SELECT avg((truth = predicted)::INTEGER) AS accuracy FROM p) SELECT label, round(coalesce(hit / nullif(called, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(called + support, 0), 0), 6) AS f1, support, round(accuracy, 6) AS accuracy, round(1 - accuracy, 6) AS misclassified FROM s, a")
def classification_report(spark, sf):
    p = F.when(F.col("l_quantity") > 25, "A").when(F.col("l_discount") > 0.05, "N").otherwise("R")
    made = T.classification_report(S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("truth"), p.alias("predicted")), "truth", "predicted")
    return made.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "misclassified")])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderkey, o_orderpriority AS label FROM orders")
def label_decode(spark, sf):
    """Labels as 0/1 arrays, and back by the place of the greatest value."""
    one_hot = F.array(*[(F.col("o_orderpriority") == x).cast("double") for x in _PRIORITIES])
    coded = S.table(spark, sf, "orders").select("o_orderkey", one_hot.alias("coded"))
    return coded.select("o_orderkey", T.decode(F.col("coded"), _PRIORITIES).alias("label"))


_STEP = "SELECT epoch + 1 AS epoch, w - 0.3 * 2 * gx AS w, b - 0.3 * 2 * g AS b, least(best, other) AS best, CASE WHEN other < best THEN 0 ELSE wait + 1 END AS wait"


@query(f"""WITH RECURSIVE c AS (SELECT (quantity - 25) / 15 AS x, log_price - 10 AS y, k % 5 > 0 AS learn FROM ({_CARS})),
m AS (SELECT avg(x) FILTER (learn) AS x, avg(y) FILTER (learn) AS y, avg(x * x) FILTER (learn) AS xx, avg(x * y) FILTER (learn) AS xy, avg(y * y) FILTER (learn) AS yy, avg(x) FILTER (NOT learn) AS vx, avg(y) FILTER (NOT learn) AS vy, avg(x * x) FILTER (NOT learn) AS vxx, avg(x * y) FILTER (NOT learn) AS vxy, avg(y * y) FILTER (NOT learn) AS vyy FROM c),
e AS (SELECT 0 AS epoch, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b, 'infinity'::DOUBLE AS best, 0 AS wait UNION ALL
{_STEP} FROM (SELECT e.*, w * xx + b * x - xy AS gx, w * x + b - y AS g, w * w * vxx + 2 * w * b * vx + b * b - 2 * w * vxy - 2 * b * vy + vyy AS other FROM e, m) WHERE epoch < 19 AND (other < best OR wait < 1))
SELECT epoch, round(w * w * xx + 2 * w * b * x + b * b - 2 * w * xy - 2 * b * y + yy, 5) AS error, round(w * w * vxx + 2 * w * b * vx + b * b - 2 * w * vxy - 2 * b * vy + vyy, 5) AS validation FROM e, m""")
def training_loop(spark, sf):
    """Gradient steps with a validation part, at most 20 epochs, early stop after two without a gain."""
    c = cars(spark, sf).select(((F.col("quantity") - 25) / 15).alias("x"), (F.col("log_price") - 10).alias("y"), (F.col("k") % 5 > 0).alias("learn"))
    c = S.Workspace(spark, "loop").table(c, "rows")
    log, _ = T.train_loop(c.where("learn"), c.where("not learn"), "x", "y")
    made = spark.createDataFrame(log, "epoch int, error double, validation double")
    return made.select("epoch", F.round("error", 5).alias("error"), F.round("validation", 5).alias("validation"))


@query(f"WITH c AS ({_CARS}) SELECT 'quantity' AS a, 'retail' AS b, round(corr(quantity, retail), 6) + 0.0::DOUBLE AS r FROM c UNION ALL SELECT 'quantity', 'size', round(corr(quantity, size), 6) + 0.0::DOUBLE FROM c UNION ALL SELECT 'quantity', 'price', round(corr(quantity, price), 6) + 0.0::DOUBLE FROM c UNION ALL SELECT 'retail', 'size', round(corr(retail, size), 6) + 0.0::DOUBLE FROM c UNION ALL SELECT 'retail', 'price', round(corr(retail, price), 6) + 0.0::DOUBLE FROM c UNION ALL SELECT 'size', 'price', round(corr(size, price), 6) + 0.0::DOUBLE FROM c")
def corr_matrix(spark, sf):
    return T.correlations(cars(spark, sf), ["quantity", "retail", "size", "price"])


@query(f"WITH c AS ({_CARS}), m AS (SELECT regr_slope(price, quantity) AS b, regr_intercept(price, quantity) AS a FROM c) SELECT round(sqrt(avg(power(price - a - b * quantity, 2))), 3) AS rmse, round(avg(abs(price - a - b * quantity)), 3) AS mae, round(1 - sum(power(price - a - b * quantity, 2)) / (count(*) * var_pop(price)), 6) AS r2 FROM c, m")
def r2_rmse(spark, sf):
    c = cars(spark, sf)
    m = c.agg(F.regr_slope("price", "quantity").alias("b"), F.regr_intercept("price", "quantity").alias("a"))
    e = c.join(F.broadcast(m)).withColumn("e", F.col("price") - F.col("a") - F.col("b") * F.col("quantity"))
    return e.agg(F.round(F.sqrt(F.avg(F.pow("e", F.lit(2)))), 3).alias("rmse"), F.round(F.avg(F.abs("e")), 3).alias("mae"), F.round(1 - F.sum(F.pow("e", F.lit(2))) / (F.count(F.lit(1)) * F.var_pop("price")), 6).alias("r2"))


_FAIR = "SELECT o_orderkey AS k, o_totalprice AS y, (c_nationkey < 8)::INTEGER::DOUBLE AS p, (c_mktsegment = 'BUILDING')::INTEGER::DOUBLE AS q FROM orders JOIN customer ON o_custkey = c_custkey"
_LATENT = f"f AS ({_FAIR}), m AS (SELECT covar_pop(p, p) AS pp, covar_pop(q, q) AS qq, covar_pop(p, q) AS pq, covar_pop(p, y) AS py, covar_pop(q, y) AS qy, avg(p) AS mp, avg(q) AS mq FROM f), l AS (SELECT k, y, p, q, y - (qq * py - pq * qy) / (pp * qq - pq * pq) * (p - mp) - (pp * qy - pq * py) / (pp * qq - pq * pq) * (q - mq) AS latent FROM f, m)"


def groups(spark, sf):
    o, c = S.table(spark, sf, "orders"), S.table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("y"), (F.col("c_nationkey") < 8).cast("double").alias("p"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("q"))


@query(f"WITH {_LATENT} SELECT k, round(latent, 3) AS latent FROM l")
def decorrelated_target(spark, sf):
    return T.decorrelated(groups(spark, sf), "y", "p", "q").select("k", F.round("latent", 3).alias("latent"))


@query(f"WITH {_LATENT} SELECT k, round(latent + 0.1 * (y - latent), 3) AS fair FROM l")
def fair_lambda(spark, sf):
    d = T.decorrelated(groups(spark, sf), "y", "p", "q")
    return d.select("k", F.round(T.fair(F.col("latent"), F.col("y"), 0.1), 3).alias("fair"))


@query(f"WITH f AS ({_FAIR}) SELECT p, q, round(avg(CASE WHEN y < 150000 THEN 1.0 ELSE 0 END), 6) AS below, count(*) AS n FROM f GROUP BY 1, 2")
def rate_below_threshold(spark, sf):
    return groups(spark, sf).groupBy("p", "q").agg(F.round(F.avg((F.col("y") < 150000).cast("double")), 6).alias("below"), F.count(F.lit(1)).alias("n"))


@query()
def ridge_lasso_grid(spark, sf):
    """Ridge, lasso and elastic net by cross-validation."""
    c = T.assemble(cars(spark, sf), ["quantity", "retail", "size"]).select("features", F.col("log_price").alias("label"))
    c = S.Workspace(spark, "grid").table(c.select(F.col("label"), "features"), "rows")
    lr = LinearRegression(maxIter=20)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).addGrid(lr.elasticNetParam, [0.0, 0.5, 1.0]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=3, seed=5).fit(c)
    rows = [(float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(v)) for g, v in zip(grid, cv.avgMetrics, strict=True)]
    return spark.createDataFrame(rows, "reg double, mix double, rmse double")


def patients(spark, sf):
    lab, d = S.table(spark, sf, "labels"), S.table(spark, sf, "documents")
    j = lab.join(d, "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("n_chars"), F.size(fn.space_tokens(F.col("text"))).cast("double").alias("n_words"), *[(F.col("lang") == x).cast("double").alias(f"lang_{x}") for x in ("de", "es", "fr")], "text")
    return j.withColumn("mean_word", F.col("n_chars") / F.greatest("n_words", F.lit(1.0)))


@query()
def logit_ablation(spark, sf):
    """Accuracy, F1 and ROC area of a logistic model, and without each feature, on a fixed 20 % of rows."""
    names = ["n_chars", "n_words", "mean_word", "lang_de", "lang_es", "lang_fr"]
    p = S.Workspace(spark, "logit").table(patients(spark, sf).drop("text"), "rows")
    rows = []
    for left_out in [None, *names]:
        made = T.assemble(p, [x for x in names if x != left_out])
        side = T.hash_split(F.col("doc_id"))
        m = LogisticRegression(maxIter=20).fit(made.where(side)).transform(made.where(~side))
        multi = MulticlassClassificationEvaluator()
        rows.append((left_out or "", *[float(multi.setMetricName(x).evaluate(m)) for x in ("accuracy", "f1")], float(BinaryClassificationEvaluator().evaluate(m))))
    return spark.createDataFrame(rows, "left_out string, accuracy double, f1 double, auc double")


@query()
def logit_cv(spark, sf):
    p = T.assemble(patients(spark, sf).drop("text"), ["n_chars", "n_words", "mean_word"]).select("label", "features")
    p = S.Workspace(spark, "logit").table(p, "rows")
    lr = LogisticRegression(maxIter=20)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1, 1.0]).addGrid(lr.elasticNetParam, [0.0, 1.0]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=3, seed=5).fit(p)
    return spark.createDataFrame([(float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(v)) for g, v in zip(grid, cv.avgMetrics, strict=True)], "reg double, mix double, auc double")


@query()
def text_classifier(spark, sf):
    """Weighted terms and a logistic model, in place of an embedding with a recurrent layer (declared substitution)."""
    p = S.Workspace(spark, "text").table(patients(spark, sf).select("doc_id", "label", "text"), "rows")
    side = T.hash_split(F.col("doc_id"))
    steps = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=10, regParam=0.01)])
    return steps.fit(p.where(side)).transform(p.where(~side)).select("doc_id", "label", F.col("prediction").alias("predicted"))


def series(spark, sf):
    return S.table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))


@query()
def forecast_linear(spark, sf):
    """One-step linear model on 6 lags, by mean absolute error on the last fifth (stands for the network forecasters)."""
    s = S.Workspace(spark, "series").table(T.lagged(series(spark, sf), ["event_type"], "hour", "v", 6), "rows")
    names = [f"lag_{k}" for k in range(1, 7)]
    cut = s.agg(F.percentile(F.unix_timestamp("hour"), F.lit(0.8)).alias("cut")).first()["cut"]
    made = T.assemble(s, names)
    m = LinearRegression(labelCol="v").fit(made.where(F.unix_timestamp("hour") <= cut)).transform(made.where(F.unix_timestamp("hour") > cut))
    return m.groupBy("event_type").agg(F.avg(F.abs(F.col("v") - F.col("prediction"))).alias("mae"), F.avg(F.abs(F.col("v") - F.col("lag_1"))).alias("persistence_mae"))


@query()
def forecast_multi_step(spark, sf):
    """Direct models for horizons 1, 6, 24 and 240, fitted on the first four fifths of the time, scored on the rest.

    A row whose target lies beyond the cut is not learned from. A horizon without rows on either side has no error.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("hour")
    s = T.lagged(series(spark, sf), ["event_type"], "hour", "v", 6).withColumns({f"y_{h}": F.lead("v", h - 1).over(w) for h in (1, 6, 24, 240)}).withColumns({f"at_{h}": F.lead("hour", h - 1).over(w) for h in (1, 6, 24, 240)})
    s = S.Workspace(spark, "series").table(s, "rows")
    cut = s.agg(F.percentile(F.unix_timestamp("hour"), F.lit(0.8)).alias("cut")).first()["cut"]
    rows = []
    for h in (1, 6, 24, 240):
        made = T.assemble(s.where(F.col(f"y_{h}").isNotNull()), [f"lag_{k}" for k in range(1, 7)])
        before, after = made.where(F.unix_timestamp(f"at_{h}") <= cut), made.where(F.unix_timestamp("hour") > cut)
        if before.isEmpty() or after.isEmpty():
            rows.append((h, None))
            continue
        m = LinearRegression(labelCol=f"y_{h}").fit(before).transform(after)
        rows.append((h, float(m.agg(F.avg(F.abs(F.col(f"y_{h}") - F.col("prediction")))).first()[0])))
    return spark.createDataFrame(rows, "horizon int, mae double")


@query()
def forecast_feedback(spark, sf):
    return T.feedback_forecast(series(spark, sf), "event_type", "hour", "v", 6, 24)


@query()
def permutation_importance(spark, sf):
    """Error with a lag column permuted over the error without, on the last fifth of the time, for one model of the rest."""
    s = S.Workspace(spark, "series").table(T.lagged(series(spark, sf), ["event_type"], "hour", "v", 3), "rows")
    names = ["lag_1", "lag_2", "lag_3"]
    cut = s.agg(F.percentile(F.unix_timestamp("hour"), F.lit(0.8)).alias("cut")).first()["cut"]
    m = LinearRegression(labelCol="v").fit(T.assemble(s.where(F.unix_timestamp("hour") <= cut), names))
    s = s.where(F.unix_timestamp("hour") > cut)

    def mae(df):
        return float(m.transform(T.assemble(df, names)).agg(F.avg(F.abs(F.col("v") - F.col("prediction")))).first()[0])

    base = mae(s)
    return spark.createDataFrame([(n, mae(T.permuted(s, n, "hour", ["event_type"])) / base) for n in names], "column_name string, ratio double")


@query("""WITH s AS (SELECT event_type AS key, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY hour) - 1 AS t, count(*) OVER (PARTITION BY key) AS n FROM s),
f AS (SELECT key, n, unnest(range(n // 2 + 1)) AS frequency FROM (SELECT DISTINCT key, n FROM n)) SELECT key, frequency, round(sqrt(power(sum(v * cos(2 * pi() * frequency * t / n.n)), 2) + power(sum(v * sin(2 * pi() * frequency * t / n.n)), 2)), 4) AS magnitude FROM f JOIN n USING (key) GROUP BY 1, 2""")
def fourier_spectrum(spark, sf):
    return T.spectrum(series(spark, sf), "event_type", "hour", "v").withColumn("magnitude", F.round("magnitude", 4))
