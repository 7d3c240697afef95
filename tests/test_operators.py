"""Operators on tiny frames with answers worked out by hand."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnfold import functions as fn
from tarnfold import sources as S
from tarnfold import streaming as T
from tarnfold.operators import clustering, graph, markup, mining, ordered, recommend, relational, search, statistics, traffic
from tarnfold.plans.streams import BITS, BLOOM
from tests.conftest import DATA


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, "Doe, Jane", fn.flip_name) == "Jane Doe"
    assert one(spark, "Cher", fn.flip_name) == "Cher"
    assert one(spark, '"11/1/2000"', fn.short_date) == "11/1/00"
    assert one(spark, "Hi @bob see https://x.co/a #Fun!", fn.clean_post) == "hi at_user see url fun"
    assert one(spark, "Été, a_b  C3!", fn.non_word_tokens) == ["été", "a_b", "c3"]


def test_leading_zero_bit(spark):
    got = spark.createDataFrame([(h,) for h in (0, 1, 2, 255, 256, 511)], "h bigint").select(fn.leading_zero_bit(F.col("h")).alias("b")).collect()
    assert [r["b"] for r in got] == [8, 8, 7, 1, 0, 0]


def test_markup_index():
    assert markup.walk('<r><b k="x1">Foo bar</b><b>foo</b><!-- no --></r>') == [("x1", "r[1]/b[1]"), ("foo", "r[1]/b[1]"), ("bar", "r[1]/b[1]"), ("foo", "r[1]/b[2]")]
    assert markup.walk('<r><b k="x1">Foo</b></r>', compat=True) == [("x1", "r/b[1]"), ("foo", "r/b[1]")]
    assert markup.walk(None) == []


def test_itemsets(spark):
    rows = [(i, x) for i, items in enumerate(["abc", "ab", "ac", "bc", "abc"]) for x in items]
    df = spark.createDataFrame(rows, "b bigint, i string")
    want = {"a": 4, "b": 4, "c": 4, "a,b": 3, "a,c": 3, "b,c": 3}
    got = mining.frequent_itemsets(mining.baskets(df, "b", "i"), 3, 5)
    assert {",".join(r["items"]): r["freq"] for r in got.collect()} == want
    for k, n in ((1, 3), (2, 3), (3, 0)):
        assert {r["items"]: r["freq"] for r in mining.itemsets_by_level(df, "b", "i", 3, k).collect()} == {s: f for s, f in want.items() if s.count(",") == k - 1}, n


def test_exact_jaccard(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [2, 3, 4, 5])], "item bigint, elements array<bigint>")
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    assert mining.exact_jaccard(pairs, sets, 0.5).first()["jaccard"] == 0.6


def test_pair_overlap(spark, monkeypatch):
    """As in a plain loop, whatever the size of the blocks; copies with other keys meet before the shuffle, so few rows go through it."""
    draw = random.Random(3)
    rows = [(None, 1), (1, None)] + [(c * 100 + draw.randrange(40), c * 1000 + p) for c in range(8) for p in range(300) for _ in range(10)]
    held = defaultdict(set)
    for a, p in rows[2:]:
        held[p].add(a)
    want = Counter(x for v in held.values() for x in combinations(sorted(v), 2))
    df = spark.createDataFrame(rows, "s bigint, p bigint")

    def written():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        was = written()
        got = {(r["a"], r["b"]): r["common"] for r in relational.pair_overlap(df, "s", "p", 1).collect()}
        moved = sum(n for k, n in written().items() if k not in was)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == want and moved < len(rows) + 1.8 * len(want)
    by_part = sorted(rows[2:], key=lambda r: r[1])
    table = pa.table({"shared": [p for _, p in by_part], "a": [a for a, _ in by_part]})
    for most, cells in ((1, 1 << 22), (100, 50), (1 << 20, 7)):
        monkeypatch.setattr(relational, "PAIR_ROWS", most)
        monkeypatch.setattr(relational, "PAIR_CELLS", cells)
        sums = Counter()
        for b in relational._pair_counts(iter(table.to_batches(64))):
            for r in b.to_pylist():
                sums[r["a"], r["b"]] += r["common"]
        assert sums == want


def test_likely_pairs(spark):
    """As bands, then agreement: copies with some hashes changed, by amounts that leave the two bits equal or not."""
    rows = [(i, *[(i // 4 * 37 + k * 101 + (i % 4 * (4 if k % 3 else 3) if k % 5 < i % 4 + 1 else 0)) % 1009 for k in range(36)]) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(["item bigint", *[f"h{k} bigint" for k in range(36)]]))
    for least in (0.2, 0.5, 0.9):
        want = {tuple(r) for r in mining.agreeing(mining.band_pairs(df, 12, 3), df, 36, least).collect()}
        assert {tuple(r) for r in mining.likely_pairs(df, 12, 3, 36, least).collect()} == want and (want or least > 0.5)


def test_similar_pairs_of_all_blocks(spark):
    """Every pair at or over the bound, across blocks, whether buckets tell sets apart or not."""
    sets = [sorted({(7 * i + k * (i % 5 + 1)) % 60 for k in range(3 + i % 9)}) for i in range(60)]
    want = {(i, j): len({*x} & {*y}) / len({*x} | {*y}) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j}
    want = {k: v for k, v in want.items() if v >= 0.5}
    df = spark.createDataFrame(list(enumerate(sets)), "item bigint, elements array<bigint>")
    for block, width in ((100, 256), (20, 256), (20, 4)):
        assert want and {(r["a"], r["b"]): r["jaccard"] for r in mining.similar_pairs(df, 60, 0.5, block, width).collect()} == want


def test_bloom_and_estimate(spark):
    rows = [(i, i % 37) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint")
    got = mining.bloom_rates(df, "event_id", "user_id", 100, 53, BLOOM).collect()
    bits, seen, want = set(), set(), {}
    for i, u in rows:
        spots = {(a * u + b) % 53 for a, b in BLOOM}
        if u not in seen:
            new, false = want.get(i // 100, (0, 0))
            want[i // 100] = (new + 1, false + (spots <= bits))
            seen.add(u)
        bits |= spots
    assert {r["batch"]: (r["n_new"], r["n_false"]) for r in got} == want


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def test_betweenness(spark):
    w = S.Workspace(spark, "t")
    path = graph.betweenness(edges(spark, [(1, 2), (2, 3), (3, 4)]), w, "a")
    assert {(r["src"], r["dst"]): r["credit"] for r in path.collect()} == {(1, 2): 3, (2, 3): 4, (3, 4): 3}
    two = [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4)]
    got = {(r["src"], r["dst"]): r["credit"] for r in graph.betweenness(edges(spark, two), w, "b").collect()}
    assert got == {(3, 4): 9, (1, 3): 4, (2, 3): 4, (4, 5): 4, (4, 6): 4, (1, 2): 1, (5, 6): 1}
    found, q = graph.girvan_newman(edges(spark, two), w, max_iter=2)
    assert round(q, 6) == 0.357143
    assert {r["node"]: r["component"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_communities_of_components_in_tasks(spark, monkeypatch):
    """Removals in tasks give what a round of jobs for each removal gives: components alike (ties), unlike and of one edge."""
    ring = [(k, (k + 1) % 5) for k in range(5)] + [(0, 2), (4, 5), (5, 6), (5, 7), (6, 7)]
    pairs = [(b + min(p), b + max(p)) for b in (0, 100) for p in ring] + [(200 + i, 201 + i) for i in range(5)] + [(300, 301)]
    rounds, plain = [], graph.modularity
    monkeypatch.setattr(graph, "modularity", lambda *a: rounds.append(1) or plain(*a))
    found, q = graph.girvan_newman(edges(spark, pairs), S.Workspace(spark, "t"))
    assert not rounds  # before: jobs for each removal
    want, best = graph.girvan_newman_by_joins(edges(spark, pairs), S.Workspace(spark, "t"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.select("node", "component").collect()} and q == pytest.approx(best)


def test_removals_keep_credits_up_to_date():
    """After each removal a part's credits are those of a walk from all its sources."""
    rng = np.random.default_rng(5)
    pairs = np.array(sorted({(min(p), max(p)) for p in rng.integers(0, 40, (110, 2)).tolist() if p[0] != p[1]} | {(k, k + 1) for k in range(39)}))
    todo, seen = [graph._Piece(np.arange(40), pairs)], 0
    while todo:
        piece = todo.pop()
        fresh = graph._Piece(piece.nodes, piece.nodes[piece.ends])
        assert np.allclose(fresh.credit, piece.credit) and (fresh.level == piece.level).all()
        parts, seen = piece.without_top(), seen + 1
        todo += [piece] if parts is None else parts
    assert seen > 40


def test_parent_counts_differ_deeper(spark):
    """Two diamonds in a row: four shortest paths reach the end, but it has two parents."""
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7)])
    w = S.Workspace(spark, "t")
    for parents, want in ((False, 4), (True, 2)):
        assert graph.bfs(e, w, f"p{parents}", parents).where("s = 1 AND v = 7").first()["sigma"] == want


@pytest.mark.parametrize("parents", [False, True])
def test_walks_in_tasks_and_by_joins_agree(spark, monkeypatch, parents):
    """Ten nodes in a circle with chords, in several blocks of sources; a tree; at last both, then one, by joins."""
    e = edges(spark, [(i, i + 1) for i in range(9)] + [(0, 9), (2, 6), (1, 8)] + [(30, 31), (30, 32), (31, 33)])
    monkeypatch.setattr(graph, "TASK_PAIRS", 30)
    w, got = S.Workspace(spark, "t"), []
    for most in (100, 10):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        levels = {(r["s"], r["v"]): (r["level"], r["sigma"]) for r in graph.bfs(e, w, f"l{most}", parents).collect()}
        got.append((levels, {(r["src"], r["dst"]): round(r["credit"], 9) for r in graph.betweenness(e, w, f"b{most}", parents).collect()}))
    assert len(got[0][0]) == 10**2 + 4**2 and got[0] == got[1]


def test_levels_take_no_turn_each(spark):
    """The tables written don't grow with the depth of the graph."""
    w = S.Workspace(spark, "t")
    assert graph.bfs(edges(spark, [(i, i + 1) for i in range(40)]), w).agg({"level": "max"}).first()[0] == 40
    assert len([p for p in Path(w.root.removeprefix("file://")).iterdir() if p.is_dir()]) < 15


def test_components_of_a_long_path(spark):
    got = graph.components(edges(spark, [(i, i + 1) for i in range(30)] + [(40, 41)]), S.Workspace(spark, "t"))
    assert {r["node"]: r["component"] for r in got.collect()} == {**dict.fromkeys(range(31), 0), 40: 40, 41: 40}


def test_no_weight_without_variance(spark):
    """Item 2 has the same rating from all users, so its pairs have no weight; the others keep theirs."""
    rows = [(u, i, float(r)) for u in range(6) for i, r in ((1, u % 5), (2, 4), (3, 5 - u % 5))]
    got = recommend.item_weights(spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")).collect()
    assert {(r["a"], r["b"]): r["weight"] for r in got} == {(1, 3): -1.0, (3, 1): -1.0}


def test_neighbour_prediction(spark):
    train = spark.createDataFrame([(1, 11, 5.0), (1, 12, 4.0), (1, 13, 1.0), (1, 14, 2.0), (2, 10, 3.0)], "user_id bigint, item_id bigint, rating double")
    weights = spark.createDataFrame([(10, 11, 0.9), (10, 12, 0.5), (10, 13, -0.2), (10, 14, 0.1)], "a bigint, b bigint, weight double")
    wanted = spark.createDataFrame([(1, 10), (1, 99), (3, 10)], "user_id bigint, item_id bigint")
    got = {(r["user_id"], r["item_id"]): r["prediction"] for r in recommend.predict(train, wanted, weights).collect()}
    assert got[(1, 10)] == pytest.approx((4.5 + 2 - 0.2) / 1.6) and got[(3, 10)] == 3 and got[(1, 99)] == 3
    weak = recommend.predict(train, wanted, weights, compat=True).where("user_id = 1 AND item_id = 10").first()["prediction"]
    assert weak == pytest.approx((0.2 - 0.2 + 2) / 0.8)


def test_rating_histogram(spark):
    df = spark.createDataFrame([("x", r) for r in (5.0, 5.0, 4.0, 1.0)] + [("y", 1.0), ("y", 5.0)], "u string, r double")
    got = {r["u"]: r for r in ordered.rating_histogram(df, "u", "r", range(1, 6)).collect()}
    assert [got["x"][f"share_{k}"] for k in range(1, 6)] == [0.25, 0, 0, 0.25, 0.5] and got["x"]["mode"] == 5 and got["y"]["mode"] == 1


def test_windows(spark):
    df = spark.range(10).select(F.lit(0).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = ordered.window_slices(df, ["k"], ["t"], ["v"], 6, 1, 1).orderBy("t").collect()
    assert len(got) == 4 and [x["v"] for x in got[0]["inputs"]] == list(range(6)) and [x["v"] for x in got[0]["labels"]] == [6]


def test_cluster_statistics(spark):
    points = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "cluster bigint, features array<double>")
    s = clustering.statistics(points)
    r = s.first()
    assert (r["n"], r["sum"], r["sumsq"]) == (2, [4, 6], [10, 20])
    near = clustering.nearest(spark.createDataFrame([(9, [2.0, 5.0])], "id bigint, features array<double>"), clustering.centres(s)).first()
    assert near["distance"] == pytest.approx(2.0) and near["cluster"] == 1


def test_fairness(spark):
    df = spark.createDataFrame([(-1.0, 0.1, 1.0), (1.0, 0.2, 3.0), (-1.0, 0.2, 2.0), (1.0, 0.1, 4.0)], "p double, q double, y double")
    d = statistics.decorrelated(df, "y", "p", "q")
    m = d.agg(F.covar_pop("latent", "p").alias("a"), F.covar_pop("latent", "q").alias("b")).first()
    assert abs(m["a"]) < 1e-9 and abs(m["b"]) < 1e-9


def test_ranked_search_and_sequences(spark):
    df = spark.createDataFrame([(1, "red ring"), (2, "red bolt"), (3, None)], "id bigint, t string")
    got = {r["id"]: r["score"] for r in search.ranked_search(df, "id", "t", ["ring", "red", "of"]).collect()}
    assert got == {1: pytest.approx(math.log(3) + math.log(1.5)), 2: pytest.approx(math.log(1.5))}
    seq = {r["id"]: r["sequence"] for r in search.sequences(df, "id", "t", search.vocabulary(df, "t", 2), 3).collect()}
    assert seq == {1: [0, 0, 1], 2: [0, 1, 2], 3: [0, 0, 0]}


def test_traffic():
    assert traffic.flow(np.array([0.3, 0.7])) == pytest.approx([0.15, 0.15])
    a, b = traffic.run(3, 200), traffic.run(3, 200)
    assert (a == b).all() and a.min() >= 0 and a.max() <= 1
    assert traffic.turn_matrix().sum(axis=1)[:8] == pytest.approx(np.ones(8))


def test_streams(spark):
    w = S.Workspace(spark, "t")
    r = {x["key"]: x for x in T.drain(T.reservoir_state(T.events_stream(spark, DATA), "event_type", "user_id", 20), w, "r").collect()}
    n = {x["event_type"]: x["n"] for x in S.table(spark, DATA, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: (v["seen"], v["held"]) for k, v in r.items()} == {k: (v, min(v, 20)) for k, v in n.items()}
    b = T.drain(T.bloom_state(T.events_stream(spark, DATA), "event_type", "user_id", BITS, BLOOM), w, "b").collect()
    new = {x["event_type"]: x["n"] for x in S.table(spark, DATA, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n")).collect()}
    assert {k: len({x["value"] for x in b if x["key"] == k}) for k in new} == new
    seen = set()
    for x in sorted(b, key=lambda x: x["event_id"]):  # a filter never forgets
        assert x["taken_for_seen"] or (x["key"], x["value"]) not in seen
        seen.add((x["key"], x["value"]))


def test_bfr_keeps_every_point(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(0, 0.1, 4) + 5 * (i // 5 % 3)).tolist()) for i in range(150)]
    points = spark.createDataFrame(rows, "id bigint, features array<double>")
    found, counts = clustering.bfr(points, S.Workspace(spark, "t"), k=3)
    assert found.count() == 150 and found.select("id").distinct().count() == 150 and len(counts) == 5
