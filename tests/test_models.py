"""Queries that SQL can't express, against NumPy or plain loops over the smallest tables."""

import http.server
import json
import random
import threading
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnfold import plans
from tarnfold import sources as S
from tarnfold import streaming as T
from tarnfold.operators import markup, ordered, relational, statistics
from tests.conftest import DATA

QUERIES = plans.queries()


def read(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def cars():
    j = read("lineitem").merge(read("part"), left_on="l_partkey", right_on="p_partkey")
    return np.column_stack([j.l_quantity, j.p_retailprice, j.p_size.astype(float)]), np.log(j.l_extendedprice.to_numpy())


def series():
    e = read("events")
    e["hour"] = e.ts.dt.floor("h")
    return e.groupby(["event_type", "hour"], as_index=False).value.mean().sort_values(["event_type", "hour"])


def lags(n):
    s = series()
    for k in range(1, n + 1):
        s[f"lag_{k}"] = s.groupby("event_type").value.shift(k)
    s = s.dropna()
    at = s.hour.astype("datetime64[s]").astype("int64").to_numpy()
    return s, at, np.quantile(at, 0.8)


def fit(x, y):
    return np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]


def test_ols_summary(spark):
    x, y = cars()
    x1 = np.column_stack([x, np.ones(len(x))])
    w = fit(x, y)
    error = np.sqrt(np.diag(np.linalg.inv(x1.T @ x1)) * ((y - x1 @ w) ** 2).sum() / (len(y) - 4))
    got = QUERIES["ols_summary"](spark, DATA).collect()
    assert [r["coefficient"] for r in got] == pytest.approx(w) and [r["error"] for r in got] == pytest.approx(error) and [r["t"] for r in got] == pytest.approx(w / error)
    assert all((r["p"] < 0.05) == (abs(r["t"]) > 1.96) for r in got if abs(abs(r["t"]) - 1.96) > 0.01)


def test_ridge_and_lasso(spark):
    got = QUERIES["ridge_lasso_grid"](spark, DATA).collect()
    x, y = cars()
    plain = np.sqrt(np.mean((y - np.column_stack([x, np.ones(len(x))]) @ fit(x, y)) ** 2))
    assert len(got) == 6 and all(plain * 0.97 < r["rmse"] < np.std(y) * 1.01 for r in got)
    by = {(r["reg"], r["mix"]): r["rmse"] for r in got}
    assert by[0.01, 0.0] <= by[0.1, 0.0] * 1.001 and by[0.01, 1.0] <= by[0.1, 1.0] * 1.001


def test_pca(spark):
    e = read("embeddings").sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    x -= x.mean(axis=0)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    got = QUERIES["pca_two_components"](spark, DATA).orderBy("id").collect()
    for k, name in enumerate(("pc1", "pc2")):
        want, have = x @ v[k], np.array([r[name] for r in got])
        assert have * np.sign(have @ want) == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_markup_index(spark):
    got = {(r["token"], r["where"], r["which"]) for r in QUERIES["xml_path_index"](spark, DATA).collect()}
    pages = read("pages")
    assert got == {(t, w, i) for i, m in zip(pages.page_id, pages.html) for t, w in markup.walk(m)}
    answer = QUERIES["xml_index_search"](spark, DATA).collect()
    hits = {(r["token"], r["where"], r["which"]) for r in answer if r["which"] is not None}
    assert hits == {x for x in got if x[0] in ("heed", "tion", "nosuchtoken")}
    assert [r["token"] for r in answer if r["which"] is None] == [w for w in ("heed", "tion", "nosuchtoken") if w not in {t for t, _, _ in hits}]


def test_elements_by_path():
    page = "<html><body><p>one <b>two</b></p><p>three<br>four</p><!-- <p>no</p> --></body></html>"
    assert [markup.element_text(page, f"html[1]/body[1]/{x}") for x in ("p[1]", "p[1]/b[1]", "p[2]", "p[3]")] == ["one two", "two", "threefour", None]
    assert markup.element_text(None, "p[1]") is None


@pytest.mark.parametrize("tag", ["title", "p", "textarea"])
def test_cut_references_stay(tag):
    """A title cut inside a reference keeps it as written; whole references are decoded once."""
    page = f"<html><head><{tag}>a &amp;&lt;b&gt; &quot;c&quot; &amp;lt; &nbsp; &copy d&amp</{tag}></head></html>"
    assert markup.element_text(page, f"html[1]/head[1]/{tag}[1]", predefined=True) == 'a &<b> "c" &lt; &nbsp; &copy d&amp'
    assert markup.element_text("<r><script>a&&b &amp; c</script></r>", "r[1]/script[1]", predefined=True) == "a&&b &amp; c"


@pytest.mark.parametrize("name, horizon", [("forecast_linear", 1)])
def test_one_step_forecast(spark, name, horizon):
    s, at, cut = lags(6)
    x, y = s[[f"lag_{k}" for k in range(1, 7)]].to_numpy(), s.value.to_numpy()
    w = fit(x[at <= cut], y[at <= cut])
    test = s[at > cut].assign(error=np.abs(y - np.column_stack([x, np.ones(len(x))]) @ w)[at > cut])
    test["persist"] = (test.value - test.lag_1).abs()
    got = {r["event_type"]: (r["mae"], r["persistence_mae"]) for r in QUERIES[name](spark, DATA).collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(test.groupby("event_type").error.mean().to_dict(), rel=1e-3)
    assert {k: v[1] for k, v in got.items()} == pytest.approx(test.groupby("event_type").persist.mean().to_dict())


def test_horizons(spark):
    s, at, cut = lags(6)
    got = {r["horizon"]: r["mae"] for r in QUERIES["forecast_multi_step"](spark, DATA).collect()}
    assert set(got) == {1, 6, 24, 240}
    for h, mae in got.items():
        y = s.groupby("event_type").value.shift(1 - h).to_numpy()
        end = s.groupby("event_type").hour.shift(1 - h)
        end = pd.to_numeric(end.astype("datetime64[s]").astype("int64")).to_numpy()
        ok = ~np.isnan(y)
        x = s[[f"lag_{k}" for k in range(1, 7)]].to_numpy()
        before, after = ok & (end <= cut), ok & (at > cut)
        if not before.any() or not after.any():
            assert mae is None
            continue
        w = fit(x[before], y[before])
        assert mae == pytest.approx(np.abs(y - np.column_stack([x, np.ones(len(x))]) @ w)[after].mean(), rel=1e-3)


def test_feedback(spark):
    got = defaultdict(dict)
    for r in QUERIES["forecast_feedback"](spark, DATA).collect():
        got[r["key"]][r["step"]] = r["forecast"]
    for key, part in series().groupby("event_type"):
        y = part.value.to_numpy()
        x = np.stack([y[i : i + 6] for i in range(len(y) - 6)])
        w, last = fit(x, y[6:]), list(y[-6:])
        for step in range(1, 25):
            last.append(float(np.append(last[-6:], 1.0) @ w))
            assert got[key][step] == pytest.approx(last[-1])


def test_permutation(spark):
    """A permuted column holds the same values of its key; the lag that tells most loses most."""
    df = spark.createDataFrame([(i % 2, i, float(i)) for i in range(200)], "k int, t int, v double")
    made = statistics.permuted(df, "v", "t", ["k"]).collect()
    assert len(made) == 200 and all(sorted(r["v"] for r in made if r["k"] == k) == [float(i) for i in range(k, 200, 2)] for k in (0, 1)) and sum(r["v"] == r["t"] for r in made) < 20
    got = QUERIES["permutation_importance"](spark, DATA).collect()
    assert [r["column_name"] for r in got] == ["lag_1", "lag_2", "lag_3"] and all(0.8 < r["ratio"] < 3 for r in got)


def test_silhouettes(spark):
    """Few clusters too many or too few: the best silhouette is near the number of labels, and all are in range."""
    got = {r["k"]: r["silhouette"] for r in QUERIES["kmeans_silhouette"](spark, DATA).collect()}
    assert sorted(got) == list(range(2, 11)) and all(-1 <= v <= 1 for v in got.values())
    rows = QUERIES["kmeans_similar_set"](spark, DATA).collect()
    assert any(r["id"] == 0 for r in rows) and len({r["prediction"] for r in rows}) == 1


def test_bfr(spark):
    e = read("embeddings")
    got = QUERIES["bfr"](spark, DATA).collect()
    assert sorted(r["id"] for r in got) == sorted(e.vec_id)
    counts = QUERIES["bfr_rounds"](spark, DATA).collect()
    total = np.cumsum([((e.vec_id % 5) == c).sum() for c in range(5)])
    assert [r["discarded"] + r["compressed"] + r["retained"] for r in counts] == total.tolist()
    assert all(a["discarded"] <= b["discarded"] for a, b in zip(counts, counts[1:]))
    label = dict(zip(e.vec_id, e.label))
    named = [r for r in got if r["cluster_id"] >= 0]
    own = Counter((r["cluster_id"], label[r["id"]]) for r in named)
    best = {c: max(n for (d, _), n in own.items() if d == c) for c in {r["cluster_id"] for r in named}}
    most = Counter(label.values()).most_common(1)[0][1] / len(label)
    assert sum(best.values()) / len(named) > most


def test_rating_models(spark):
    rows = QUERIES["gbt_model"](spark, DATA).collect()
    truth, made = np.array([r["rating"] for r in rows]), np.array([r["prediction"] for r in rows])
    assert len(rows) > 50 and made.min() >= 1 and made.max() <= 5
    assert np.sqrt(np.mean((truth - made) ** 2)) < 1.25 * truth.std()
    both = QUERIES["hybrid_model"](spark, DATA).collect()
    assert {(r["user_id"], r["item_id"]) for r in both} == {(r["user_id"], r["item_id"]) for r in rows} and all(1 <= r["blended"] <= 5 for r in both)


def test_classifiers(spark):
    j = read("labels").merge(read("documents"), on="doc_id")
    most = max(j.quality.mean(), 1 - j.quality.mean())
    ablation = {r["left_out"]: r for r in QUERIES["logit_ablation"](spark, DATA).collect()}
    assert set(ablation) == {"", "n_chars", "n_words", "mean_word", "lang_de", "lang_es", "lang_fr"}
    assert ablation[""]["accuracy"] > most - 0.15 and all(0 <= r["auc"] <= 1 and 0 <= r["f1"] <= 1 for r in ablation.values())
    grid = QUERIES["logit_cv"](spark, DATA).collect()
    assert len(grid) == 6 and all(0 <= r["auc"] <= 1 for r in grid) and max(r["auc"] for r in grid) > 0.5
    told = QUERIES["text_classifier"](spark, DATA).collect()
    assert told and np.mean([r["label"] == r["predicted"] for r in told]) > most - 0.15


def test_reservoir(spark):
    """The same draws in a plain loop, a snapshot after every hundred events of a type."""
    got = {(r["key"], r["seen"]): (r["held"], r["slots"]) for r in QUERIES["reservoir_stateful"](spark, DATA).collect()}
    want = {}
    for key, part in read("events").sort_values("event_id").groupby("event_type"):
        slots = []
        for n, v in enumerate(part.user_id, 1):
            if len(slots) < 100:
                slots.append(v)
            elif (draw := random.Random(f"553:{key}:{n}")).random() < 100 / n:
                slots[draw.randrange(100)] = v
            if n % 100 == 0:
                want[key, n] = (len(slots), ",".join(map(str, slots[::20])))
    assert got == want and want


def test_traffic(spark):
    rows = QUERIES["traffic_run"](spark, DATA).collect()
    assert rows and {r["scenario"] for r in rows} == set(range(4))


def test_stream_draws(spark):
    """A rate source would do as well: requests are any frame of ids."""
    lines = spark.createDataFrame([(i, f"u{i % 5}") for i in range(50)], "n int, v string")
    got = [r["value"] for r in T.draws(lines, "n", "v", spark.range(4000), S.Workspace(spark, "t")).collect()]
    n = Counter(got)
    assert len(got) == 4000 and set(n) == {f"u{k}" for k in range(5)} and max(n.values()) < 1.2 * min(n.values())
    assert T.draws(lines.limit(0), "n", "v", spark.range(5), S.Workspace(spark, "t")).count() == 0


def test_index_over_partitions(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("x"), F.lit("a").alias("y")).repartition(9)
    got = relational.with_index(df, [F.col("x")], S.Workspace(spark, "t")).collect()
    assert sorted((r["x"], r["_index"]) for r in got) == [(k + 1, k) for k in range(1000)]


def test_reports_of_odd_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "t string, p string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in statistics.classification_report(df, "t", "p").collect()}
    assert got == {"a": (1.0, 0.5, pytest.approx(2 / 3), 2), "b": (0.0, 0.0, 0.0, 1), "c": (0.0, 0.0, 0.0, 0)}


def test_early_stop(spark):
    train = spark.createDataFrame([(float(x), 2.0 * x) for x in (-1, 0, 1)], "x double, y double")
    log, (slope, _) = statistics.train_loop(train, train, "x", "y", epochs=20, rate=0.3)
    assert len(log) == 20 and slope == pytest.approx(2.0, abs=0.05)
    log, best = statistics.train_loop(train, train, "x", "y", epochs=20, rate=3.0)
    assert len(log) == 3 and best == (0.0, 0.0)


def test_put_documents(spark):
    got = {}

    class Keep(http.server.BaseHTTPRequestHandler):
        def do_PUT(self):
            got[self.path] = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Keep)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("a b", 1), ("c/d", 2)], "k string, v int")
    assert S.put_documents(df, f"http://127.0.0.1:{server.server_port}/chats", "k") == 2
    server.shutdown()
    assert got == {"/chats/a%20b.json": {"k": "a b", "v": 1}, "/chats/c%2Fd.json": {"k": "c/d", "v": 2}}


def test_charts_hold_bounded_points(spark, tmp_path):
    with pytest.raises(ValueError):
        S.write_chart(spark.range(20).select("id", F.col("id").alias("y")), str(tmp_path / "c"), "bar", "id", "y", most=10)
    spec = json.loads(spark.read.text(S.write_chart(ordered.histogram(spark.range(20), "id", 0, 20, 4), str(tmp_path / "c"), "bar", "bin", "n")).first()["value"])
    assert spec["mark"] == "bar" and len(spec["data"]["values"]) == 4
