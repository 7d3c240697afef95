"""Operators of the subpackage on small tables: nulls, empty and long texts, repeats, clashing columns, brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnfold.llm import decontamination, jaccard_join, license_scan, mixing, neighbours, pii, quality, queries, secret_scan, sharding, stages, suffix_dedup, words
from tarnfold.llm.scratch import Scratch
from tests.conftest import DATA

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, rid string, size string, region string"


def docs(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None if k % 7 == 6 else f"src{k % 3}", len(t or ""), "x", "y", "z", "w") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


WORDS = [f"{a}{b}" for a in "bcdfghklmn" for b in ("a", "en", "ist", "our")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    return [None, "", "   \n", "one", "ONE", "a b c d", *base, *base[:10], *near, prose(rng, 20_000)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def test_word_hashes():
    h, s, e = words.words("Hello  the\tWORLD the é".encode())
    assert list(zip(s.tolist(), e.tolist())) == [(0, 5), (7, 10), (11, 16), (17, 20), (21, 23)] and h[1] == h[3]
    assert words.words(b"HELLO")[0][0] == h[0] and not len(words.words(b" \n")[0])
    assert len(words.shingles(b"a b")) == 1 and len(words.shingles(b"a b c d e f")) == 2 and not len(words.shingles(b""))


def test_quality(spark):
    rng = random.Random(1)
    good = [prose(rng, 30) for _ in range(150)]
    bad = [" ".join(w + "***" for w in prose(rng, 30).split()) for _ in range(150)]
    d = docs(spark, good + bad + [None, ""], [*range(300), 900, None])
    lab = labels(spark, [(i, int(i < 150), 0, "t") for i in range(300)] + [(0, 0, 0, "t"), (5, None, 0, "t"), (None, 1, 0, "t")])
    got = {r["doc_id"]: r for r in quality.classify(d, lab).collect()}
    assert len(got) == 302
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(300))
    assert np.mean([got[i]["predicted"] == (i < 150) for i in held]) > 0.95
    assert got[900]["score"] == got[None]["score"]
    none = quality.classify(d, lab.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    assert quality.classify(d.limit(0), lab).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(1200, 16)) + 4 * rng.integers(0, 3, (1200, 1))
    rows = [(i, v.tolist(), i) for i, v in enumerate(points)] + [(i, points[100].tolist(), 0) for i in range(2000, 2040)]
    odd = [(3000, None, 0), (3100, [0.0] * 16, 0), (3200, [float("nan")] * 16, 0), (3300, [1.0] * 15 + [None], 0), (3400, [1.0, 2.0], 0), (None, [1.0] * 16, 0), (100, points[100].tolist(), 5)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, i bigint")
    neighbours.LEAF_ROWS, kept = 200, neighbours.LEAF_ROWS
    try:
        got = neighbours.nearest(df).collect()
    finally:
        neighbours.LEAF_ROWS = kept
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert set(by) == {i for i, _, _ in rows if i % 100 == 0}
    hits = 0
    for q, found in by.items():
        v = np.array(dict((i, x) for i, x, _ in rows)[q])
        want = sorted((float(np.sqrt(((np.array(x) - v) ** 2).sum())), i) for i, x, _ in rows if i != q)[:10]
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 11)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        hits += sum(s <= want[-1][0] + 1e-9 for _, s, _ in found)
    assert hits >= 0.9 * 10 * len(by)
    assert neighbours.nearest(df.limit(0)).count() == 0


PII = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and pii._luhn(re.sub(r"\D", "", m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.findall("[0-9]", m)) <= 15))


def pii_brute(t):
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(PII) for m in re.finditer(p, t) if ok(m[0])]


def test_pii_base_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a1@.+- 2(é") for _ in range(rng.randint(1, 30)))
        assert pii_brute(t) == pii.base_spans(t)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_pii_patterns_find_unseen(spark):
    seen = [f"hello please call me at +1 (555) 010-{1000 + i} today, thanks" for i in range(20)]
    new = ["hello please call me at 555-010-2001 today, thanks", None, "", "order number 1234567 shipped", "mail joe@x.example.com now"]
    got = [r for r in pii.find(docs(spark, seen + new)).orderBy("doc_id").collect()]
    assert [r["n_found"] for r in got] == [0] * 20 + [1, 0, 0, 0, 0] and got[20]["spans"] == "phone:24:36"
    assert got[24]["spans"] == "email:5:22" and got[24]["base_sha256"] == hashlib.sha256(b"email:5:22").hexdigest()
    assert got[21]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(docs(spark, [None]).limit(0)).count() == 0


def test_sharding(spark, texts):
    d = docs(spark, texts)
    got = sharding.shard_documents(d.unionAll(d.limit(3))).collect()
    assert len(got) == len(texts) + 3
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
        assert r["grown_shard"] in (r["shard"], 40)
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    many = spark.range(4000).select(F.col("id").alias("k"))
    w = sharding.assign(many, "k", [1.0, 1.0, 2.0]).groupBy("shard").count().collect()
    assert abs({r["shard"]: r["count"] for r in w}[2] - 2000) < 150
    assert sharding.shard_documents(d.limit(0)).count() == 0


def test_license(spark):
    t = ["prose here\nReleased under the MIT License.\nmore prose", "this work is LICENSED under the GNU general public license version 3", None, "", "a b c", license_scan.TEMPLATES[3][1].replace(" of ", "\nof "), "Permission is hereby granted"]
    got = license_scan.scan(docs(spark, t)).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == ["MIT", "GPL-3.0", "", "", "", "MIT", ""] and got[0]["best_dice"] == 1.0 and got[2]["best"] is None


def jaccard_brute(texts):
    sets, up = [], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set())
    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, texts, small, monkeypatch):
    """The second run has regions of a few members only, so that pivots, windows and blocks do the work."""
    rng = random.Random(9)
    base = prose(rng, 120).split()
    copies = []
    for _ in range(40):  # near copies, some linked through others only
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        copies.append(" ".join(w))
    every = [*texts, *copies]
    if small:
        for name, value in (("LEAF", 3), ("PIVOTS", 2), ("PART", 4), ("BLOCK", 2), ("DEPTH", 2), ("PRUNE", 8)):
            monkeypatch.setattr(jaccard_join, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs(spark, every)).collect()}
    assert [got[i] for i in range(len(every))] == jaccard_brute(every)


def test_jaccard_empty(spark):
    assert jaccard_join.join(docs(spark, ["x"]).limit(0)).count() == 0
    assert [tuple(r) for r in jaccard_join.join(docs(spark, [None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]


def dedup_brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("large", [65536, 2])
def test_suffix_dedup(spark, large, monkeypatch):
    """The second run counts single strings for nearly every seed."""
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rng = random.Random(3)
    a, b = prose(rng, 150), prose(rng, 110)
    t = [None, "", "short", a, a, f"{prose(rng, 30)} {b} {prose(rng, 40)}", f"{prose(rng, 50)} {b}", f"{b} x", "ab" * 700, "z" * 399, "z" * 400, "z" * 401, prose(rng, 3000), f"é{a[:500]}", b + b]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.dedup(docs(spark, t)).collect()}
    assert [got[i] for i in range(len(t))] == dedup_brute(t)
    assert suffix_dedup.dedup(docs(spark, t).limit(0)).count() == 0


def test_mixing(spark, texts):
    rng = random.Random(5)
    d = docs(spark, [*texts, *[prose(rng, 400) for _ in range(120)]])
    rows = [r for r in mixing.mix(d).collect()]
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(5)).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again and all(r["taken"] <= 3 * r["size"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    cap, weight, want = {s: 3 * v for s, v in size.items()}, {"src0": 1, "src1": 2, "src2": 3, None: 1}, {}
    rest, total = set(size), sum(size.values())
    while True:
        share = (total - sum(want.values())) / sum(weight[s] for s in rest)
        over = {s for s in rest if share * weight[s] > cap[s]}
        if not over:
            break
        want |= {s: cap[s] for s in over}
        rest -= over
    want |= {s: share * weight[s] for s in rest}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) < 0.03 * target[s] + 128 for s in size)
    assert mixing.mix(d.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (20, 35, 60, 200, 12)] + [None, "", "two words"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, leaks string")
    clean = [prose(random.Random(100 + i), 300) for i in range(10)]
    dirty = [f"{prose(rng, 90)} {items[k].upper()}! {prose(rng, 70)}" for k in range(5)]
    got = [r["leaks"] for r in decontamination.find_leaks(docs(spark, [None, "", *clean, *dirty]), bench).orderBy("doc_id").collect()]
    assert [[x["item_id"] for x in leaks] for leaks in got] == [[]] * 12 + [[k] for k in range(5)]
    assert decontamination.find_leaks(docs(spark, clean), bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_secrets(spark):
    rng = random.Random(7)
    key = "AKIA" + "Q7W2" * 4
    shared = "9f" * 20
    opaque = "aB3dE5fG7hJ9kL1mN3pQ5rS7"
    t = [f'token = "{shared}" {i}' for i in range(5)] + [f"{key} and api-key: short", f"PassWord: {opaque}xyz", f"see {opaque} here", None, "", "token=secret:abcdefgh"]
    t += ["".join(rng.choice("tokenpaswd=: \"AKI0af") for _ in range(200)) for _ in range(60)]
    got = [r for r in secret_scan.scan(docs(spark, t)).orderBy("doc_id").collect()]
    for text, r in zip(t, got):
        found = []
        for o, (kind, pattern, ok) in enumerate((("assign", secret_scan.ASSIGN, lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32))):
            found += [(m.start(), o, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if ok(m)]
        base = ",".join(x[2] for x in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))
    assert got[0]["n_example"] == 2 and got[0]["n_live"] == 0 and got[5]["n_live"] == 1 and "opaque:4:28" in got[7]["spans"]
    assert secret_scan.scan(docs(spark, t).limit(0)).count() == 0


def test_stages(spark, texts):
    """Each stage keeps the columns it was given, and its decisions take effect."""
    lab = labels(spark, [(i, 1, 0, "t") for i in range(20)])
    d = docs(spark, texts)
    made = stages.near_duplicate_stage(spark, d, DATA)
    assert made.columns == d.columns
    groups = [c for _, c in jaccard_brute(texts)]
    assert made.count() == len(set(groups))
    assert lab.count() and [name for name, _ in corpus_pipeline.STAGES][-1] == "sharding"
    out = stages.mixing_stage(spark, Scratch(spark, "t").table(d, "docs"), DATA)
    assert out.columns == d.columns and max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 3


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0 and {"doc_id", "shard", "slot"} <= set(rows.columns)


def test_queries_match_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, DATA), c.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        assert sorted(str([r[k] for k in columns]) for r in df.collect()) == sorted(str(list(r)) for r in want.select(*[f'"{k}"' for k in columns]).fetchall())


def test_secrets_copied_in_one_source(spark):
    """A value in many documents of one source is an example, one in few of them is live; a repository of two owners counts once."""
    copied, own = "aB3dE5fG7hJ9kL1mN3pQ5rS7", "zY9xW7vU5tS3rQ1pN2mL4kJ6"
    d = docs(spark, [f"see {copied} here, password={copied}"] * 8 + [f"see {own} here"] * 2).withColumn("source", F.lit("hot"))
    got = secret_scan.scan(d).orderBy("doc_id").collect()
    assert [(r["spans"], r["repos"], r["owners"], r["n_live"], r["n_example"]) for r in got] == [("assign:35:68", [8], [1], 0, 1)] * 8 + [("opaque:4:28", [2], [1], 1, 0)] * 2
    two = secret_scan.scan(docs(spark, [f"see {own} here"] * 2, [1, 1])).first()
    assert (two["repos"], two["owners"]) == ([1], [2])


def test_seeds_across_pieces(monkeypatch):
    """Cutting a text into pieces loses no seed, wherever its end lies."""
    data = prose(random.Random(8), 1200).encode()
    for n in (*range(1024 + 60, 1024 + 404, 7), 1087, 1423, 2048 + 64, 2048 + 399, 3000):
        monkeypatch.setattr(suffix_dedup, "_STEP", 1 << 20)
        whole = suffix_dedup.seeds(data[:n])
        monkeypatch.setattr(suffix_dedup, "_STEP", 1024)
        assert all((a == b).all() for a, b in zip(whole, suffix_dedup.seeds(data[:n]), strict=True)), n


def test_contexts_are_let_go(monkeypatch):
    """Once a group's units stand in columns, the rows they came in take no memory any more; several groups and both grains."""
    draw = np.random.default_rng(5)

    def batches():
        for k in range(12):  # groups 0 and 1 over some batches, then small ones
            group, words_ = np.sort(draw.integers(0, 2, 1000)) + k // 6 * 2, k % 2
            parts = [draw.integers(97, 99, 720).astype(np.uint8).tobytes() for _ in range(1000)]
            columns = [group, np.zeros(1000), np.full(1000, 30), np.full(1000, words_), np.arange(1000) + k * 1000, np.full(1000, 39 if words_ else 336), np.zeros(1000), np.ones(1000)]
            names = ["group", "lo", "hi", "seed", "context", "left", "first", "last"]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in columns], pa.array(parts, pa.binary())], [*names, "part"])
            del parts, columns

    before, held = pa.total_allocated_bytes(), []
    monkeypatch.setattr(suffix_dedup, "induce", lambda *a, f=suffix_dedup.induce: held.append(pa.total_allocated_bytes() - before) or f(*a))

    class Frame:
        repartition = sortWithinPartitions = lambda self, *_: self
        mapInArrow = lambda self, work, _: work

    for _ in suffix_dedup.sort_contexts(Frame())(batches()):
        pass
    assert held and max(held) < 2_500_000  # of 8.6 million bytes; the batch at hand is one of 0.8 million


def test_suffix_dedup_long_copies(spark):
    """Copies of a text just beyond a piece go to their last byte."""
    rng = random.Random(12)
    t = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=(1 << 20) + 200))
    got = suffix_dedup.dedup(docs(spark, [t, t])).collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got] == [(len(t), len(t), 1)] * 2


def test_pii_spaced_and_long_identifiers(spark):
    """Runs across single spaces are candidates of any length; a run is reported once, not with its tokens."""
    seen = [f"hello please call me at +1 (555) 010-{1000 + i} today, thanks" for i in range(5)]
    seen += [f"my card number 4111 1111 1111 1111{x} expires soon" for x in ("", " ")] + ["my card number 5500 0000 0000 0004 expires soon", "my card number 4012 8888 8888 1881 expires soon"]
    new = ["hello please call me at 555 010 2001 today, thanks", "my card number 4111 1111 1111 1112 expires soon", "hello please call me at (555) 0102003 today, thanks", "at 1 2 3 4"]
    got = [r["spans"] for r in pii.find(docs(spark, seen + new)).orderBy("doc_id").collect()]
    assert got[9:] == ["phone:24:36", "card:15:34", "phone:25:37", ""]
    long = "someone." * 20 + "x@localhost"
    assert pii.candidates(f"mail {long} now", []) == [(5, 5 + len(long), 5, True)]


def test_pii_unseen_do_not_count_against_a_pattern(spark):
    """Four seeds and twenty unseen numbers in a context, all found; six misfits in another leave its unseen alone."""
    t = [f"reach our desk at +1 (555) 010-{1000 + i} any time" for i in range(4)] + [f"reach our desk at 555-020-{2000 + i} any time" for i in range(20)]
    t += [f"see also item +1 (555) 030-{1000 + i} there" for i in range(4)] + [f"see also item {12345 + i} there" for i in range(6)] + ["see also item 555-040-2001 there"]
    got = [r["n_found"] for r in pii.find(docs(spark, t)).orderBy("doc_id").collect()]
    assert got == [0] * 4 + [1] * 20 + [0] * 11


def test_question_with_a_part_of_its_answer_leaks(spark):
    """The whole question with the beginning of a long answer leaks; the question alone, or half of it, doesn't."""
    rng = random.Random(16)
    question, answer = prose(rng, 30) + ".", prose(rng, 30)
    bench = spark.createDataFrame([(0, f"{question} {answer}")], "item_id bigint, text string")
    half = " ".join(answer.split()[:14])
    got = [len(r["leaks"]) for r in decontamination.find_leaks(docs(spark, [f"{question} {half} {prose(rng, 40)}", question, " ".join(question.split()[:15]) + f" {half}"]), bench).orderBy("doc_id").collect()]
    assert got == [1, 0, 0]
