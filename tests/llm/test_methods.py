"""The methods against plain versions of themselves: pivots, seeds, pivots of WAND, permutations, scores, graphs."""

import math
import random
import struct
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnfold.llm import bitmaps, decontamination, jaccard_join, mixing, neighbours, pii, quality, secret_scan, sharding, stages, suffix_dedup, words
from tarnfold.llm.scratch import Scratch
from tests.conftest import DATA
from tests.llm.test_llm import docs, jaccard_brute, labels, prose

# Jaccard join


def parts(n, links):
    near = jaccard_join.Union(n)
    for a, b in links:
        near.join(a, b)
    return [near.root(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_regions_by_pivots(monkeypatch, seed):
    """Pivots, cells and windows connect what all pairs connect, in regions of near copies, chains and strangers."""
    rng = np.random.default_rng(seed)
    sets = []
    while len(sets) < 120:
        s = np.unique(rng.integers(0, 1 << 40, rng.integers(3, 60)).astype(np.uint64))
        for _ in range(rng.integers(1, 12)):  # a chain: each copy differs a little from the one before
            sets.append(s)
            s = np.unique(np.concatenate([rng.choice(s, max(1, len(s) - int(rng.integers(0, 4))), replace=False), rng.integers(0, 1 << 40, int(rng.integers(0, 3))).astype(np.uint64)]))
    order = rng.permutation(len(sets))
    sets, used = [sets[i] for i in order], []
    plain = jaccard_join._overlaps
    monkeypatch.setattr(jaccard_join, "_overlaps", lambda *a: used.append(1) or plain(*a))
    n = len(sets)
    got = list(jaccard_join.region_links(list(range(n)), list(range(n)), sets))
    size = [len(s) for s in sets]
    want = [(i, j) for i in range(n) for j in range(i) if jaccard_join.linked(len(np.intersect1d(sets[i], sets[j])), size[i], size[j])]
    assert used and parts(n, got) == parts(n, want) and all(a != b for a, b in got) and set(map(frozenset, got)) <= set(map(frozenset, want))


def equally_far(n, rng):
    """Sets that share two thirds of their shingles: no two are linked, and windows around pivots part none of them."""
    core = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    return [np.unique(np.concatenate([core, rng.integers(0, 1 << 62, 50).astype(np.uint64)])) for _ in range(n)]


def test_cells_that_repeat_each_other_meet_once(monkeypatch):
    """Regions of sets equally far from all pivots: twelve cells of nearly all members each are joined as one."""
    sets, met = equally_far(192, np.random.default_rng(1)), []
    plain = jaccard_join.intersections
    monkeypatch.setattr(jaccard_join, "intersections", lambda own: met.append(len(own)) or plain(own))
    assert not list(jaccard_join.region_links(list(range(192)), list(range(192)), sets))
    assert sum(m * m for m in met) < 2 * 192**2


def test_crowded_cells_become_one_region(spark):
    """Three cells of the same four members become one, which goes to the blocks; cells apart from each other stay."""
    crowded = [(1, r, c, c, 10) for r in (11, 12, 13) for c in range(4)]
    apart = [(2, 21 + c // 2, c, c, 10) for c in range(4)]
    made = spark.createDataFrame(crowded + apart, "parent bigint, region bigint, cid bigint, root bigint, was bigint")
    got = [tuple(r) for r in jaccard_join.uncrowded(made).collect()]
    assert sorted(r for r in got if r[3]) == [x[1:] for x in apart]
    one = [r for r in got if not r[3]]
    assert sorted(r[1:3] for r in one) == [(c, c) for c in range(4)] and len({r[0] for r in one}) == 1


def test_copies_share_no_anchor_and_ranks_part_counts(spark):
    """A class read in two tasks doesn't make its anchors shared; a passage in 80 texts shows among cells of 400."""
    made = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 8), (2, 9)], "cid bigint, anchor bigint")
    assert [tuple(r) for r in jaccard_join.shared_anchors(made, Scratch(spark, "t")).collect()] == [(8, 1)]
    low, high, most = jaccard_join.ranks(np.array([400, 480, 2**32 - 1]))
    assert low < high < most


def test_profiles_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m in ((20, 25), (600, 700), (900, 1100), (5000, 6000), (40_000, 41_000)):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, len(a) * 9 // 10, replace=False), rng.integers(0, 1 << 62, m - n).astype(np.uint64)]))
        p, q = jaccard_join.profile(a), jaccard_join.profile(b)
        buckets = min(len(p), len(q))
        assert np.abs(jaccard_join.folded(p, buckets) - jaccard_join.folded(q, buckets)).sum() <= len(np.setxor1d(a, b))
    kept = {frozenset(x) for x in jaccard_join._alike([jaccard_join.profile(s) for s in (a, b, a[:100], a[:95])], np.array([len(a), len(b), 100, 95]))}
    assert {frozenset((2, 3))} <= kept and frozenset((0, 2)) not in kept


def test_pivots_run_on_tables(spark, monkeypatch):
    """Regions of the shared tables' size go by pivots in their task, and the groups are those of brute force."""
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(d).collect()}
    at = {i: r["doc_id"] for i, r in enumerate(rows)}
    brute, least = jaccard_brute([r["text"] for r in rows]), {}
    for i, (_, c) in enumerate(brute):
        least[c] = min(least.get(c, at[i]), at[i])
    assert [got[at[i]] for i in range(len(rows))] == [least[c] for _, c in brute]


def test_ids_that_clash_come_apart(spark):
    df = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 8, 3), (4, None, None)], "doc_id bigint, cid bigint, check bigint")
    got = {r["doc_id"]: r["cid"] for r in jaccard_join.apart(df, spark.createDataFrame([(7,)], "cid bigint")).collect()}
    assert got[1] != got[2] and got[1] != 7 and got[3] == 8 and got[4] is None


def test_bitmaps_let_wanted_keys_through(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    wanted = df.where("k % 7 = 0 or k > 2990")
    made = Scratch(spark, "bits").table(bitmaps.pages(wanted, "k", 20), "pages")
    got = {r["k"] for r in bitmaps.holding(df.select((F.col("k")).alias("k")), "k", made, 20).collect()}
    want = {r["k"] for r in wanted.collect()}
    assert want <= got and len(got) < len(want) + 60


def test_a_document_of_copies_and_one_far_off(spark):
    """Repeated rows, ties of ids, null ids, and a very long text beside its near copy."""
    rng = random.Random(21)
    long = prose(rng, 30_000).split()
    near = list(long)
    near[100] = "other"
    t = [" ".join(long), " ".join(near), "a b c d e f", "a b c d e f", "A b C d e F", None]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.join(docs(spark, t, [5, 4, 3, 3, None, 9])).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (3, 3), (3, 3), (None, 3), (9, 9)], key=str)


# Repeats


def shared_brute(texts, k=51):
    runs = defaultdict(set)
    split = [(t or "").encode().split() for t in texts]
    for i, w in enumerate(split):
        for j in range(len(w) - k + 1):
            runs[tuple(w[j : j + k])].add(i)
    out = []
    for w in split:
        in_ = np.zeros(len(w), bool)
        for j in range(len(w) - k + 1):
            if len(runs[tuple(w[j : j + k])]) > 1:
                in_[j : j + k] = True
        out.append(int(in_.sum()))
    return out


@pytest.mark.parametrize("large", [8192, 2])
def test_shared_passages(spark, large, monkeypatch):
    """Passages of 51 words and more of two documents, not those within one; the second run splits nearly every seed."""
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rng = random.Random(31)
    p = [prose(rng, n) for n in (50, 51, 60, 130)]
    t = [f"{prose(rng, 20 + 7 * k)} {x} {prose(rng, 15)}" for x in p for k in range(4)]
    t += [f"{prose(rng, 30)} {p[3]} {p[3]}", " ".join([prose(rng, 70)] * 2), p[2], None, "", p[3], f"{p[1]} x", "w " * 51, "w " * 60]
    got = {r["doc_id"]: r["n_shared_words"] for r in suffix_dedup.dedup(docs(spark, t)).collect()}
    assert [got[i] for i in range(len(t))] == shared_brute(t)


def test_halves_keep_every_string(monkeypatch):
    """Contexts cut by a text's edges: a group's common part is the same for all that share a string."""
    rng = random.Random(2)
    data = prose(rng, 400).encode()
    at = suffix_dedup.seeds(data)[0]
    assert len(at) and all(0 <= p <= len(data) - suffix_dedup.GRAM for p in at)
    for i in range(0, len(data) - 399, 13):  # each string has a seed
        assert any(i <= p <= i + suffix_dedup.REACH for p in at)


# Decontamination


def test_wand_finds_all_above_their_thresholds():
    rng = random.Random(41)
    items = [(i, prose(rng, rng.randint(1, 90)).encode()) for i in range(150)]
    df = Counter(x for _, t in items for x in set(words.tokens(t).tolist()))
    terms = np.array(sorted(df), np.uint64)
    sizes = [len(words.tokens(t)) for _, t in items]
    mean = sum(sizes) / len(sizes)
    index = decontamination.Index(items, len(items), mean, terms, np.array([df[int(x)] for x in terms], float))
    place = {i: k for k, i in enumerate(index.ids)}
    found = 0
    for _ in range(150):
        own = items[rng.randrange(len(items))][1].decode().split()
        text = " ".join([*own[: rng.randint(0, len(own))], *prose(rng, rng.randint(1, 40)).split()])
        asked = np.unique(words.tokens(text.encode())[: decontamination.PASSAGE])
        at = np.searchsorted(terms, asked)
        known = [int(k) for k, x in zip(at, asked) if k < len(terms) and terms[k] == x]
        want = {}
        for i, t in items:
            h = Counter(words.tokens(t).tolist())
            score = 0.0
            for x in asked.tolist():
                if x in h:
                    idf = math.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5))
                    score += idf * h[x] * (decontamination.K1 + 1) / (h[x] + decontamination.K1 * (1 - decontamination.B + decontamination.B * sum(h.values()) / mean))
            if score >= index.least[place[i]]:
                want[i] = score
        got = {index.ids[k]: s for k, s in index.wand(known)}
        assert got == pytest.approx(want)
        first = np.array([0, len(known)])
        assert not want or index.reachable(first, np.array(known))[0]
        found += len(want)
    assert found > 50


def test_parts_of_the_index_give_the_same(spark, monkeypatch):
    rng = random.Random(43)
    bench = spark.createDataFrame([(i, prose(rng, 30)) for i in range(40)] + [(3, prose(rng, 25)), (None, "x y"), (90, None)], "item_id bigint, text string")
    held = bench.where("item_id < 40").collect()
    t = [f"{prose(rng, 40)} {r['text']} {prose(rng, 10)}" for r in held[::3]] + [prose(rng, 200) for _ in range(5)] + [None, "", held[0]["text"] + " " + prose(rng, 20_000)]
    d = docs(spark, t).withColumn("leaks_of_part_0", F.lit("kept"))

    def run():
        got = decontamination.find_leaks(d, bench)
        assert got.columns == [*d.columns, "leaks"] and got.where("leaks_of_part_0 = 'kept'").count() == len(t)
        return [[(x["item_id"], round(x["score"], 9), x["overlap"]) for x in r["leaks"]] for r in got.orderBy("doc_id").collect()]

    whole = run()
    monkeypatch.setattr(decontamination, "PART_ITEMS", 7)
    assert run() == whole and sum(map(len, whole)) >= 14


# Mixing


def test_permutations(spark):
    for n in (1, 2, 3, 5, 12, 97, 1000):
        for key in ("a", "b"):
            got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(key))).collect()]
            assert sorted(got) == list(range(n))
    a, b = ([r[0] for r in spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000).cast("long"), mixing.round_keys(k))).collect()] for k in ("a", "b"))
    assert sum(x == y for x, y in zip(a, b)) < 20 and sum(abs(x - y) == 1 for x, y in zip(a, a[1:])) < 50


def test_draws_of_output_shards(spark):
    """Every output shard is full, counts of a source vary between shards about as a multinomial's, and their sum is what the target asks."""
    rng = random.Random(5)
    d = docs(spark, [prose(rng, 900) for _ in range(400)])
    scratch = Scratch(spark, "t")
    sized = scratch.table(d.select("source", F.lit(900).alias("size")), "sized")
    sources = scratch.table(mixing.targets(sized), "sources")
    made = scratch.table(mixing.slots(sources, scratch, shard_blocks=100), "slots")
    assert made.select("shard", "place").distinct().count() == made.count() and made.agg(F.max("place")).first()[0] == 99
    drawn = mixing.draws(made).collect()
    target, all_ = {r["rank"]: r["target"] / 64 for r in sources.collect()}, made.count()
    for rank, want in target.items():
        counts = [r["n"] for r in drawn if r["rank"] == rank and r["shard"] < all_ // 100]
        assert abs(sum(r["n"] for r in drawn if r["rank"] == rank) - want) <= 1
        share = want / all_
        assert 0.4 < np.var(counts) / (100 * share * (1 - share)) < 2.2
    blocks = made.groupBy("rank", "block").count().groupBy("rank").agg(F.max("count").alias("hi"), F.min("count").alias("lo")).collect()
    assert all(r["hi"] - r["lo"] <= 1 and r["hi"] <= 3 for r in blocks if r["lo"])


# Sharding


def test_rendezvous_against_a_loop(spark):
    keys, weights = [0, 1, 5, 77, 10**12, -3], [1.0, 2.0, 0.5, 1.0]

    def bid(key, shard):
        h = xxhash.xxh64_intdigest(struct.pack("<i", sharding.SEED), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(struct.pack("<q", key), h))
        return -weights[shard] / math.log(((h >> 11) + 0.5) / 2.0**53)

    df = spark.createDataFrame([(k,) for k in [*keys, *range(500)]], "k bigint")
    got = {r["k"]: r["shard"] for r in sharding.assign(df, "k", weights).collect()}
    assert all(got[k] == max(range(4), key=lambda s: bid(k, s)) for k in got)


# Quality


def test_training_against_a_plain_loop(spark):
    """Weights in dictionaries, one coordinate after the other; repeated and long labelled documents; pieces of few features."""
    rng = random.Random(11)
    t = [prose(rng, rng.randint(3, 40)) + (" bad!!" if i % 2 else " fine") for i in range(60)] + [prose(rng, 20_000)]
    d = docs(spark, [*t, *t[:10]], [*range(61), *range(10)])
    lab = labels(spark, [(i, 1 - i % 2, 0, "t") for i in range(61)])
    got = quality.train(spark, d, lab, bits=12, epochs=2)
    order = [r["id"] for r in spark.range(61).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id")).collect()]
    z, n = defaultdict(float), defaultdict(float)

    def w(i):
        return 0.0 if not z[i] else -z[i] / ((1.0 + math.sqrt(n[i])) / 4.0 + 0.001)

    for _ in range(2):
        for k in order:
            i, x = quality.features(t[k].encode(), 12)
            row = [*zip(i.tolist(), x.astype(np.float32).tolist()), (1 << 12, 1.0)]
            g = 1 / (1 + math.exp(-sum(w(a) * v for a, v in row))) - (1 - k % 2)
            for a, v in row:
                s = (math.sqrt(n[a] + (g * v) ** 2) - math.sqrt(n[a])) / 4.0
                z[a] += g * v - s * w(a)
                n[a] += (g * v) ** 2
    assert got == pytest.approx(np.array([w(i) for i in range((1 << 12) + 1)]), rel=1e-4, abs=1e-5)
    scores = {(r["doc_id"], r["score"]) for r in quality.score(d.select("doc_id", "text"), got, bits=12).collect()}
    assert len(scores) == 61


# Personal data


def test_bootstrap_against_a_plain_loop(spark):
    rng = random.Random(51)
    edges = {}
    for i in range(60):
        kind = rng.choice([0, 1, 2, 3, -1, -1])
        shapes = [kind] if kind >= 0 else rng.sample(range(4), rng.randint(0, 2))
        for _ in range(rng.randint(1, 4)):
            edges.setdefault((rng.choice([kind, rng.randrange(4)]) * 10 + rng.randrange(3), i), (kind, shapes))
    df = spark.createDataFrame([(p, i, k, s) for (p, i), (k, s) in edges.items()] * 2, "p bigint, i bigint, kind int, shapes array<int>")
    got = {r["i"]: r["kind"] for r in pii.bootstrap(df, Scratch(spark, "t")).collect()}
    seeds = {i: {k: 1.0} for (_, i), (k, _) in edges.items() if k >= 0}
    known, found = dict(seeds), {}
    for _ in range(pii.TURNS):
        score = {}
        for p in {p for p, _ in edges}:
            for k in range(4):
                support = against = 0.0
                for (q, i), (_, shapes) in edges.items():
                    if q == p:
                        c = known.get(i, {})
                        support += c.get(k, 0.0)
                        against += max(max(c.get(j, 0.0) for j in range(4) if j != k) - c.get(k, 0.0), 0.0) if k in shapes else 1.0
                if support >= pii.SUPPORT and support / max(support + against, pii.SUPPORT) >= pii.CONFIDENT:
                    score[p, k] = support / max(support + against, pii.SUPPORT)
        found = defaultdict(dict)
        for (p, i), (kind, shapes) in edges.items():
            for k in shapes if kind < 0 else []:
                if (p, k) in score:
                    found[i][k] = 1 - (1 - found[i].get(k, 0.0)) * (1 - min(score[p, k], 0.999))
        known = seeds | found
    want = {i: max(c, key=lambda k: (c[k], -k)) for i, c in found.items() if max(c.values()) >= pii.CONFIDENT}
    assert got == want


def test_identifiers_found_by_their_spelling(spark):
    """A phone number lost in a longer run of digits, and a card beside another, are spelled like seeds; failing check digits are not cards."""
    seen = [f"{prose(random.Random(i), 5)} +1 ({200 + i}) 555-{1000 + i} {prose(random.Random(i + 50), 4)}" for i in range(6)] + [f"so {c} and" for c in ("4111111111111111", "5500000000000004", "4012888888881881", "4222222222222220", "4000056655665556")]
    new = ["un +1 (843) 555-7672 170.106.47.218 et", "esan 2353820953013749 4111111111111111 thheed", "x 2353820953013749 y", None, "", "no " + "word " * 30_000 + "+1 (843) 555-7672 170.106.47.218"]
    rows = pii.find(docs(spark, seen + new)).orderBy("doc_id").collect()
    got = rows[len(seen) :]
    assert got[0]["spans"] == "ip:21:35,phone:3:20" and got[0]["n_spans"] == 2 and got[1]["spans"] == "card:22:38"
    assert [r["n_found"] for r in got] == [1, 1, 0, 0, 0, 1] and rows[0]["n_spans"] == 1
    again = pii.find(docs(spark, [new[0]] * 3 + seen)).orderBy("doc_id").limit(3).collect()
    assert [r["n_found"] for r in again] == [1, 1, 1]


def test_long_runs_beside_identifiers_stay_linear():
    text = ",".join(["10.0.0.1"] * 40_000) + "," + "a" * 300_000 + "@x.com"
    base = pii.base_spans(text)
    assert len(base) > 40_000 and all(len(pii._edges(text, s, e, 0, k, [k])) >= 1 for k, s, e in base)


# Secrets


def test_ownership_against_counting(spark, monkeypatch):
    rng = random.Random(61)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(8)]
    t = [f"key {rng.choice(values)} {'x ' * rng.randint(0, 3)}{rng.choice(values)}" for _ in range(80)] + [None, "", "y" * 50_000 + " " + values[0]]
    d = docs(spark, [*t, *t[:5]], [*range(len(t)), *range(5)])
    source = {(r["doc_id"], r["text"]): r["source"] for r in d.collect()}
    repos, owners = defaultdict(set), defaultdict(set)
    for (i, x), s in source.items():
        for v in (x or "").split():
            if v in values:
                repos[v].add(i)
    for r in d.collect():
        for v in (r["text"] or "").split():
            if v in values:
                owners[v].add(r["source"])
    for hot in (1000, 5):  # the second time most values are hot
        monkeypatch.setattr(secret_scan, "HOT", hot)
        for r in secret_scan.scan(d).collect():
            held = [v for v in ((t[r["doc_id"]] or "").split()) if v in values]
            assert r["n_hex"] == len(held) and r["repos"] == [len(repos[v]) for v in held] and r["owners"] == [len(owners[v]) for v in held]


def test_secret_pieces(spark):
    """Any length of an opaque token, matches side by side, signs of more than one code unit before them."""
    opaque = "aB3dE5fG7hJ9kL1mN3pQ5rS7" * 20
    t = [f"😀 é {opaque} AKIA{'Q' * 16}AKIA{'R' * 16} AKIA{'S' * 12}", "token=abcdefgh token=abcdefgh", "secret: " + "z" * 100_000]
    got = secret_scan.scan(docs(spark, t)).orderBy("doc_id").collect()
    assert got[0]["spans"] == f"opaque:4:{4 + len(opaque)},access:{5 + len(opaque)}:{45 + len(opaque)},access:{46 + len(opaque)}:{62 + len(opaque)}"
    assert got[1]["n_assign"] == 2 and got[2]["spans"] == "assign:0:100008"


# Stages


def clashing(d):
    return d.withColumns({c: F.lit(f"own {c}") for c in ("_rid", "_score", "_leaks", "_copy", "_digest", "_RID_")})


@pytest.mark.parametrize("name", ["quality_stage", "near_duplicate_stage", "decontamination_stage", "mixing_stage"])
def test_stages_keep_columns_of_any_name(spark, name):
    rng = random.Random(71)
    t = [None, "", *[prose(rng, rng.randint(5, 60)) for _ in range(30)], prose(rng, 20_000)]
    d = Scratch(spark, "t").table(clashing(docs(spark, [*t, *t[:6]], [None, None, *range(31), *range(6)])), "docs")
    stage = getattr(stages, name)
    made = stage(spark, d, DATA)
    assert made.columns == d.columns
    rows = made.collect()
    assert rows and all(r["_rid"] == "own _rid" and r["_copy"] == "own _copy" for r in rows)
    empty = Scratch(spark, "t").table(d.limit(0), "empty")
    assert stage(spark, empty, DATA).count() == 0 and stage(spark, empty, DATA).columns == d.columns
    again = stage(spark, Scratch(spark, "t").table(d.repartition(7), "other"), DATA).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_quality_stage_drops_what_the_score_rejects(spark):
    d = Scratch(spark, "t").table(spark.read.parquet(f"{DATA}/documents.parquet"), "docs")
    kept = {r["doc_id"] for r in stages.quality_stage(spark, d, DATA).collect()}
    told = quality.classify(d, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    assert kept == {r["doc_id"] for r in told if r["predicted"]} and len(kept) < len(told)


def test_decontamination_stage_drops_leaks(spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    rng = random.Random(81)
    t = [f"{prose(rng, 40)} {bench[0]['text']} {prose(rng, 40)}", prose(rng, 300), None, ""]
    made = stages.decontamination_stage(spark, Scratch(spark, "t").table(docs(spark, t), "docs"), DATA)
    assert sorted(r["doc_id"] for r in made.collect()) == [1, 2, 3]


def test_sharding_stage(spark):
    d = docs(spark, ["a", None, "a", ""], [1, None, 1, 2])
    got = stages.sharding_stage(spark, Scratch(spark, "t").table(d, "docs"), DATA).collect()
    assert len(got) == 4 and all(0 <= r["shard"] < 40 for r in got)
    assert stages.sharding_stage(spark, d.limit(0), DATA).count() == 0


# Neighbours


def test_queries_meet_leaves_in_blocks(spark, monkeypatch):
    """Directions at random, so queries reach nearly all leaves: no table holds a row for a query and a leaf (F2), and results are brute force's."""
    points = np.random.default_rng(5).normal(size=(1200, 16))
    points[7] = points[40]  # one point of two ids
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id bigint, embedding array<double>")
    written, plain = [], Scratch.table

    def table(self, frame, name, *rest):
        out = plain(self, frame, name, *rest)
        written.append((out.count(), name))
        return out

    monkeypatch.setattr(Scratch, "table", table)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 20)
    monkeypatch.setattr(neighbours, "QUERY_NUMBERS", 50 * 16, raising=False)
    got = defaultdict(list)
    for r in neighbours.nearest(df, every=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    hits = 0
    for i in range(0, 1200, 10):
        d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        want = sorted((x, j) for j, x in enumerate(d.tolist()) if j != i)[:10]
        assert len(got[i]) == 10 and got[i] == sorted(got[i])
        hits += len({j for _, j in got[i]} & {j for _, j in want})
    assert got[40][0] == (0.0, 7) and hits >= 0.95 * 1200
    assert max(written)[0] <= 1320, written


def test_contexts_of_words_stay_small():
    """Aligned contexts of a large group take little more than their own units (F4)."""
    grain, rng = suffix_dedup.WORDS, np.random.default_rng(3)
    lefts, rights = rng.integers(0, grain.reach + 1, (2, 20000))
    sizes = lefts + grain.gram + rights
    units = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in sizes]
    parts = pa.array([u.tobytes() for u in units], pa.binary())
    tracemalloc.start()
    try:
        text, pad = suffix_dedup._matrix(parts, lefts, grain)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * 20000 * grain.length * 8
    for k in range(0, 20000, 997):
        first = grain.reach - lefts[k]
        column = text[:, k]
        assert (column[first : first + sizes[k]] == units[k]).all() and (column[:first] == pad).all() and (column[first + sizes[k] :] == pad).all()
