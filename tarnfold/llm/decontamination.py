"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then overlap of word runs.

Index: the items' tokens with BM25 impacts, postings by term in the order of items, items in blocks of ``BLOCK``; for
each term its largest impact, overall and in each block where it stands. Document frequencies and the mean length are
those of all items, whatever part of the index an item is in.
Queries: every passage (``PASSAGE`` tokens, every ``STRIDE``) of every document, by WAND: cursors on the postings of the
passage's terms, in the order of the items they stand at; the pivot is the first item that the terms' largest impacts can
lift to the lowest threshold; if the block maxima at the pivot can't reach the lowest threshold of its block, all cursors
skip that block, else the pivot is scored exactly and retrieved if it is at or above its own threshold (``ALPHA`` of the
score that the item's own passages reach). A passage whose block maxima reach the threshold in no block at all is let go
before its cursors start; these sums are taken for many passages at once.
Verification: the share of the item's distinct five-token runs that stand in the document around the passage; an item
leaks if that share is at least 0.8, or if that of its question (all but its last sentence, or its first half) is and
any run of its answer, if it has one, stands there too. The three shares are returned.

Index parts hold about ``PART_ITEMS`` items and ``PART_TOKENS`` tokens each (items are dealt to parts by a hash of id and
text). Each part is built in a task, once, and broadcast built; parts pass the driver one by one, so what is broadcast at
once has a bound whatever the size of the benchmark.

Defined results: a null or empty text leaks nothing; items without tokens or without an id are never found, items of
fewer than five tokens only as a whole run; repeated items are found each; with no items nothing leaks; equal rows are
rows of their own; an empty table gives an empty result; further columns stay as they are.
"""

from __future__ import annotations

import bisect
import math
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.scratch import Scratch
from tarnfold.llm.words import runs_of, tokens

PASSAGE, STRIDE, BLOCK, RUN = 64, 32, 8, 5
ALPHA, OVERLAP, K1, B = 0.6, 0.8, 1.2, 0.75
PART_ITEMS, PART_TOKENS = 4096, 1_000_000
#: Sums of block maxima that are held at once.
_CELLS = 4_000_000
HIT = "array<struct<item_id:bigint,score:double,overlap:double,question:double,answer:double>>"
_SENTENCE = re.compile(rb"(?<=[.!?])\s+")


def passages(n: int) -> np.ndarray:
    """Starts of the passages of a text of n tokens."""
    return np.arange(0, max(n - PASSAGE + STRIDE, 1), STRIDE) if n else np.empty(0, np.int64)


def question_and_answer(text: bytes) -> tuple[bytes, bytes]:
    parts = [p for p in _SENTENCE.split(text) if len(tokens(p))]
    if len(parts) > 1:
        return b" ".join(parts[:-1]), parts[-1]
    words = text.split()
    return b" ".join(words[: (len(words) + 1) // 2]), b" ".join(words[(len(words) + 1) // 2 :])


class Index:
    """One part of the inverted index: ``items`` (id, text), and over all items their number, mean length and document
    frequencies (of the part's terms, sorted)."""

    def __init__(self, items: list[tuple[int, bytes]], total: int, mean: float, terms: np.ndarray, df: np.ndarray):
        # Items of like length, and so of like thresholds, share a block.
        held = sorted(((i, t, h) for i, t in items if len(h := tokens(t))), key=lambda x: (len(x[2]), x[0], x[1]))
        self.ids = [i for i, _, _ in held]
        self.sizes = [len(h) for _, _, h in held]
        self.terms = terms
        counted = [np.unique(np.searchsorted(terms, h), return_counts=True) for *_, h in held]
        term = np.concatenate([t for t, _ in counted]) if held else np.empty(0, np.int64)
        item = np.repeat(np.arange(len(held)), [len(t) for t, _ in counted])
        count = np.concatenate([c for _, c in counted]).astype(float) if held else np.empty(0)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * np.array(self.sizes, float)[item] / mean))
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order]
        self.start = np.searchsorted(term, np.arange(len(terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(terms) else np.empty(0)
        # Block maxima, only where a term stands.
        key = term * (len(held) // BLOCK + 1) + self.item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.block, self.block_most = self.item[first] // BLOCK, np.maximum.reduceat(self.impact, first) if len(key) else np.empty(0)
        self.block_start = np.searchsorted(term[first], np.arange(len(terms) + 1))
        self.least, self.runs, self.question, self.answer = [], [], [], []
        for k, (_, text, h) in enumerate(held):
            own = [self.score(k, np.unique(np.searchsorted(terms, h[s : s + PASSAGE])).tolist()) for s in passages(len(h))]
            self.least.append(ALPHA * min(own[:-1] if len(own) > 1 else own) - 1e-6)
            size = min(RUN, len(h))
            self.runs.append((size, np.unique(runs_of(h, size))))
            for to, part in zip((self.question, self.answer), question_and_answer(text), strict=True):
                to.append(np.unique(runs_of(tokens(part), size)))
        self.block_least = np.array([min(self.least[b : b + BLOCK]) for b in range(0, len(held), BLOCK)])
        self.lowest = min(self.least, default=math.inf)

    def score(self, item: int, terms: list[int]) -> float:
        """BM25 of a passage (distinct term numbers) against one item."""
        total = 0.0
        for t in terms:
            a, e = int(self.start[t]), int(self.start[t + 1])
            at = a + int(np.searchsorted(self.item[a:e], item))
            if at < e and self.item[at] == item:
                total += float(self.impact[at])
        return total

    def reachable(self, first: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages with a block whose maxima reach its lowest threshold; passage p has the terms first[p] to first[p + 1]."""
        blocks, out = len(self.block_least), np.zeros(len(first) - 1, bool)
        step = max(1, _CELLS // max(blocks, PASSAGE))
        for p in range(0, len(out), step):
            q = min(p + step, len(out))
            t = term[first[p] : first[q]]
            passage = np.repeat(np.arange(q - p), np.diff(first[p : q + 1]))
            n = self.block_start[t + 1] - self.block_start[t]
            # At most PASSAGE terms a passage, so the sums are bounded piece by piece.
            sums = np.zeros((q - p) * blocks)
            ends = np.cumsum(n)
            at = 0
            while at < len(t):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS)))
                m = n[at:to]
                place = np.repeat(self.block_start[t[at:to]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                sums += np.bincount(np.repeat(passage[at:to] * blocks, m) + self.block[place], self.block_most[place], len(sums))
                at = to
            out[p:q] = (sums.reshape(q - p, blocks) >= self.block_least - 1e-6).any(axis=1)
        return out

    def wand(self, terms: list[int]) -> Iterator[tuple[int, float]]:
        """(item number, score) of all items at or above their thresholds for a passage (distinct term numbers)."""
        cursors = []  # item, place in its list, list of items, impacts, largest impact, blocks, block maxima
        for t in terms:
            a, e, ba, be = (int(x) for x in (self.start[t], self.start[t + 1], self.block_start[t], self.block_start[t + 1]))
            items = self.item[a:e].tolist()
            cursors.append([items[0], 0, items, self.impact[a:e], float(self.most[t]), self.block[ba:be].tolist(), self.block_most[ba:be]])

        def advance(cursor: list, item: int) -> None:
            at = bisect.bisect_left(cursor[2], item, cursor[1])
            cursor[1], cursor[0] = at, cursor[2][at] if at < len(cursor[2]) else math.inf

        while True:
            cursors = sorted((c for c in cursors if c[0] != math.inf), key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += c[4]
                if total >= self.lowest:
                    pivot = c[0]
                    break
            if pivot is None:
                return
            block, bound = pivot // BLOCK, 0.0
            front = [c for c in cursors if c[0] <= pivot]
            for c in front:
                at = bisect.bisect_left(c[5], block)
                if at < len(c[5]) and c[5][at] == block:
                    bound += float(c[6][at])
            if bound < self.block_least[block]:
                # Nothing in the rest of the block either, up to the next cursor.
                after = min([(block + 1) * BLOCK, *(c[0] for c in cursors[len(front) :])])
                for c in front:
                    advance(c, after)
            elif front[0][0] < pivot:
                for c in front:
                    advance(c, pivot)
            else:
                score = sum(float(c[3][c[1]]) for c in front)
                if score >= self.least[pivot]:
                    yield pivot, score
                for c in front:
                    advance(c, pivot + 1)

    def search(self, text: bytes | None) -> list[dict]:
        """The items that leak into a whole text."""
        h = tokens(text or b"")
        if not len(h) or not len(self.ids):
            return []
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        place = np.flatnonzero(self.terms[at] == h)  # the other tokens stand in no item
        term = at[place]
        starts = passages(len(h))
        # Each place lies in the passages (place - PASSAGE, place] / STRIDE; a term counts once a passage.
        pairs = []
        for back in range(PASSAGE // STRIDE):
            passage = place // STRIDE - back
            inside = (passage >= 0) & (passage < len(starts))
            pairs.append(passage[inside] * len(self.terms) + term[inside])
        pair = np.sort(np.concatenate(pairs))
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        passage, term = np.divmod(pair, len(self.terms))
        first = np.searchsorted(passage, np.arange(len(starts) + 1))
        found: dict[int, tuple[float, float, float, float]] = {}
        for p in np.flatnonzero(self.reachable(first, term)):
            for k, score in self.wand(term[first[p] : first[p + 1]].tolist()):
                size, own = self.runs[k]
                around = runs_of(h[max(0, starts[p] - self.sizes[k]) : starts[p] + PASSAGE + self.sizes[k]], size)
                shares = [np.isin(x, around).mean() if len(x) else 0.0 for x in (own, self.question[k], self.answer[k])]
                asked = shares[1] >= OVERLAP and (shares[2] > 0 or not len(self.answer[k]))
                if (shares[0] >= OVERLAP or asked) and (k not in found or shares[0] > found[k][1]):
                    found[k] = (score, *map(float, shares))
        names = ("score", "overlap", "question", "answer")
        return [{"item_id": int(self.ids[k]), **dict(zip(names, v, strict=True))} for k, v in sorted(found.items(), key=lambda x: (self.ids[x[0]], x[0]))]


def build(benchmark: DataFrame, scratch: Scratch, id_col: str = "item_id", text_col: str = "text") -> Iterator[bytes]:
    """The parts of the index, each built in a task; one at a time reaches the driver."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), text.alias("t"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [tokens(t) for t in pdf["t"]]
            yield pd.DataFrame({"i": pdf["i"], "t": pdf["t"], "n": [len(h) for h in made], "terms": [np.unique(h).view(np.int64) for h in made]})

    rows = scratch.table(rows.mapInPandas(hashed, "i bigint, t binary, n bigint, terms array<bigint>").where("n > 0"), "items")
    seen = rows.agg(F.count(F.lit(1)).alias("total"), F.avg("n").alias("mean"), F.sum("n").alias("tokens")).first()
    if not seen["total"]:
        return
    count = max(math.ceil(seen["total"] / PART_ITEMS), math.ceil(seen["tokens"] / PART_TOKENS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(count)).cast("int"))
    each = dealt.select("part", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    zero, nothing = F.lit(0).cast("long"), F.lit(b"")  # no nulls: 64-bit numbers beside them would come as floats
    known = each.distinct().join(df, "term").select("part", F.lit(1).alias("kind"), zero.alias("i"), nothing.alias("t"), "term", "df")
    every = dealt.select("part", F.lit(0).alias("kind"), "i", "t", zero.alias("term"), zero.alias("df")).unionByName(known)
    total, mean = seen["total"], float(seen["mean"])

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        items, facts = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        terms = facts["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(terms)
        index = Index([(int(i), bytes(t)) for i, t in zip(items["i"], items["t"], strict=True)], total, mean, terms[order], facts["df"].to_numpy(float)[order])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "index": [pickle.dumps(index)]})

    parts = scratch.table(every.groupBy("part").applyInPandas(made, "part int, index binary"), "parts")
    for r in parts.orderBy("part").select("part").collect():  # numbers of the parts
        yield bytes(parts.where(F.col("part") == r["part"]).first()["index"])


def searcher(shared: Broadcast) -> Callable[[Column], Column]:
    """Searches whole texts in one broadcast part of the index."""

    @F.pandas_udf(HIT)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = pickle.loads(shared.value)
        for batch in texts:
            yield pd.Series([index.search(t) for t in batch])

    return search


def find_leaks(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "leaks") -> DataFrame:
    """All rows and columns of ``documents`` with the leaking items, an array of structs, in ``out``."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "benchmark")
    made, names = documents, []
    for k, part in enumerate(build(benchmark, scratch)):
        shared = spark.sparkContext.broadcast(part)  # about PART_ITEMS items and PART_TOKENS tokens
        names.append(f"{out}_of_part_{k}")
        while names[-1] in documents.columns:
            names[-1] += "_"
        made = made.withColumn(names[-1], searcher(shared)(F.col(text_col).cast("binary")))
    scratch.drop("items", "parts")
    if not names:
        return documents.withColumn(out, F.array().cast(HIT))
    every = F.array_sort(F.concat(*names)) if len(names) > 1 else F.col(names[0])
    return made.withColumn(out, every).drop(*names)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, contaminated, item_ids, n_items, best_overlap`` for every row of ``documents``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = find_leaks(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.transform("leaks", lambda x: x["item_id"])
    best = F.coalesce(F.array_max(F.transform("leaks", lambda x: x["overlap"])), F.lit(0.0))
    return got.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), ids.alias("item_ids"), F.size("leaks").cast("long").alias("n_items"), best.alias("best_overlap"))
