"""Regression, fairness, splits, spectra and forecasts."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def hash_split(key: Column, train: int = 80) -> Column:
    """True for the training part; a row's side never changes."""
    return F.pmod(F.xxhash64(key), F.lit(100)) < train


def ols(df: DataFrame, target: str, columns: list[str]):
    """Least squares with a constant, solved by normal equations: one pass."""
    return LinearRegression(labelCol=target, featuresCol="features", solver="normal").fit(assemble(df, columns))


def vif(df: DataFrame, columns: list[str]) -> list[tuple[str, float]]:
    """Variance inflation 1 / (1 - R2) of each column on the others (centred)."""
    out = []
    for c in columns:
        rest = [x for x in columns if x != c]
        r2 = ols(df, c, rest).summary.r2
        out.append((c, float("inf") if r2 >= 1 else 1 / (1 - r2)))
    return out


def correlations(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """``a, b, r`` for all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.round(F.corr(a, b), digits) + F.lit(0.0)).alias("r")).alias(f"{a}__{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*row.columns)).alias("c")).select("c.*")


def decorrelated(df: DataFrame, target: str, p: str, q: str, out: str = "latent") -> DataFrame:
    """Target without what two protected columns tell of it: the residual of least squares on both, centre kept off."""
    pairs = {"pp": (p, p), "qq": (q, q), "pq": (p, q), "py": (p, target), "qy": (q, target)}
    m = df.agg(*[F.covar_pop(a, b).alias(k) for k, (a, b) in pairs.items()], F.avg(p).alias("mp"), F.avg(q).alias("mq"))
    d = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    m = m.select("mp", "mq", ((F.col("qq") * F.col("py") - F.col("pq") * F.col("qy")) / d).alias("b1"), ((F.col("pp") * F.col("qy") - F.col("pq") * F.col("py")) / d).alias("b2"))
    j = df.join(F.broadcast(m))  # one row
    return j.withColumn(out, F.col(target) - F.col("b1") * (F.col(p) - F.col("mp")) - F.col("b2") * (F.col(q) - F.col("mq"))).drop("mp", "mq", "b1", "b2")


def fair(latent: Column, target: Column, share: float) -> Column:
    """Between the decorrelated target and the target."""
    return latent + F.lit(share) * (target - latent)


def lagged(df: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """Columns ``lag_1`` and so on; rows without all of them go."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)}).na.drop(subset=[f"lag_{lags}"])


def permuted(df: DataFrame, column: str, order: str, keys: list[str], seed: int = 3) -> DataFrame:
    """The column's values in another, fixed order within each key."""
    a = Window.partitionBy(*keys).orderBy(order)
    b = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), order))
    at = df.withColumn("_at", F.row_number().over(a))
    other = df.select(*keys, F.row_number().over(b).alias("_at"), F.col(column).alias("_value"))
    return at.join(other, [*keys, "_at"]).withColumn(column, F.col("_value")).drop("_at", "_value")


def spectrum(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, frequency, magnitude``: discrete Fourier transform of each series (a series fits a task)."""
    kind = df.schema[key].dataType.simpleString()

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        series = pdf.sort_values(order)[value].to_numpy(float)
        size = np.abs(np.fft.rfft(series))
        return pd.DataFrame({"key": pdf[key].iloc[0], "frequency": np.arange(len(size)), "magnitude": size})

    return df.select(key, order, value).groupBy(key).applyInPandas(transform, f"key {kind}, frequency bigint, magnitude double")


def feedback_forecast(df: DataFrame, key: str, order: str, value: str, lags: int, steps: int) -> DataFrame:
    """``key, step, forecast``: a linear model of the last values, fitted a series, fed with its own forecasts."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(float)
        if len(y) <= lags + 1:
            return pd.DataFrame({"key": [], "step": [], "forecast": []})
        x = np.stack([np.append(y[i : i + lags], 1.0) for i in range(len(y) - lags)])
        w = np.linalg.lstsq(x, y[lags:], rcond=None)[0]
        last, out = list(y[-lags:]), []
        for _ in range(steps):
            out.append(float(np.append(last[-lags:], 1.0) @ w))
            last.append(out[-1])
        return pd.DataFrame({"key": pdf[key].iloc[0], "step": range(1, steps + 1), "forecast": out})

    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"key {kind}, step bigint, forecast double")


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``label, precision, recall, f1, support, accuracy, misclassified``: a row a class, from one sum over the pairs.

    A class that is never predicted has precision 0, one that never occurs recall 0.
    """
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    every = pairs.agg(F.sum("n").alias("all"), hit.alias("hits"))
    sides = F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("true")), F.struct(F.col("p").alias("label"), F.lit(False).alias("true")))
    each = pairs.select("t", "p", "n", F.explode(sides).alias("x")).select("t", "p", "n", "x.*")
    per = each.groupBy("label").agg(
        F.sum(F.when(F.col("true"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("true"), F.col("n")).otherwise(0)).alias("called"),
        F.sum(F.when(F.col("true") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("right"),
    )
    zero = F.lit(0.0)
    per = per.withColumn("precision", F.coalesce(F.try_divide("right", "called"), zero)).withColumn("recall", F.coalesce(F.try_divide("right", "support"), zero))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    out = per.join(F.broadcast(every))  # one row
    return out.select("label", "precision", "recall", f1.alias("f1"), "support", (F.col("hits") / F.col("all")).alias("accuracy"), (1 - F.col("hits") / F.col("all")).alias("misclassified"))


def importance(df: DataFrame, target: str, columns: list[str]) -> list[tuple[str, float, float]]:
    """``column, coefficient, importance``: least squares; importance is the size of the coefficient in standard deviations."""
    model = ols(df, target, columns)
    scale = df.agg(*[F.stddev_samp(c).alias(c) for c in [*columns, target]]).first()
    return [(c, float(w), abs(float(w)) * scale[c] / scale[target]) for c, w in zip(columns, model.coefficients, strict=True)]


def decode(one_hot: Column, labels: list) -> Column:
    """The label of the greatest value of an array (ties: the first)."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(one_hot, F.array_max(one_hot)).cast("int"))


def train_loop(train: DataFrame, valid: DataFrame, feature: str, target: str, epochs: int = 20, rate: float = 0.3, patience: int = 2) -> tuple[list[tuple[int, float, float]], tuple[float, float]]:
    """(epoch, training and validation error) and the best (slope, constant): gradient steps on the mean squared error.

    It stops early once ``patience`` epochs bring no better validation error. An epoch is one sum over both parts.
    """
    both = train.select(F.col(feature).alias("x"), F.col(target).alias("y"), F.lit(True).alias("learn")).unionByName(valid.select(F.col(feature).alias("x"), F.col(target).alias("y"), F.lit(False).alias("learn")))
    slope = constant = 0.0
    log, best, kept, waited = [], float("inf"), (0.0, 0.0), 0
    for epoch in range(epochs):
        e = F.col("x") * slope + constant - F.col("y")
        learn = F.when(F.col("learn"), e)
        r = both.agg(F.avg(learn * F.col("x")).alias("gx"), F.avg(learn).alias("g"), F.avg(learn * learn).alias("error"), F.avg(F.when(~F.col("learn"), e * e)).alias("other")).first()
        log.append((epoch, float(r["error"]), float(r["other"])))
        if r["other"] < best:
            best, kept, waited = r["other"], (slope, constant), 0
        else:
            waited += 1
            if waited >= patience:
                break
        slope, constant = slope - rate * 2 * r["gx"], constant - rate * 2 * r["g"]
    return log, kept
