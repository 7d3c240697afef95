"""Removal of repeated byte strings by induced suffix sorting with common-prefix values.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else, in its own document or another.
Beside it, by the same steps over words in place of bytes: the words of passages of more than 50 words that stand in
another document too (``n_shared_words``), which finds shorter passages and leaves repeats inside one document aside.

1. Seeds. Each run of ``gram`` units (bytes or words) has a hash; of every ``window`` neighbouring units the run with the
   least hash is a seed (all of them, if several). Equal strings choose equal seeds at equal offsets, so all places where
   a string stands meet under one seed. Seeds that stand once are done with: most of the corpus. A count of each seed
   moves once; a bitmap of the repeated ones then lets little more than their places through.
2. A seed's context are the units that a string around it may reach, ``reach`` to either side. Places with equal
   contexts repeat each other wholly; only distinct contexts of seeds with two or more of them are sorted.
3. Contexts of a seed are aligned suffixes. Their order and the common-prefix values of neighbours are induced from the
   last unit to the first: a step takes the tuples (suffix, common prefix) from the queue in order and puts each into
   the queue of the unit before it; the new common prefix of neighbours is one more than the least value between them.
   A string starting at a column repeats where a value of at least ``window`` stands beside it. Spark's external sort
   brings the tuples of a shard into the order of their groups, on disk where memory ends; a task holds the queues of
   ``BATCH`` contexts at a time.
4. A seed with more than ``LARGE`` distinct contexts is split: the strings that start in one half of its columns all hold
   a middle part, and only contexts with the same part can share one of them. Contexts that agree in all that a half's
   strings cover are done with it, and one stands for them. The halves are split again until groups are small. So no
   group has to fit a task beyond ``LARGE`` contexts, and a passage in a third of all documents costs its contexts a
   few rows a level: only the halves that its edges cross go on.

Defined results: null and empty texts have no bytes (the hash of no bytes); texts shorter than ``WINDOW`` bytes keep
all; equal rows are rows of their own and repeat each other; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm import bitmaps
from tarnfold.llm.jaccard_join import _bounded, _groups
from tarnfold.llm.scratch import Scratch
from tarnfold.llm.words import mix, words


@dataclass(frozen=True)
class Grain:
    """What strings are made of: ``window`` units a string, ``gram`` units a seed."""

    window: int
    gram: int

    @property
    def reach(self) -> int:
        return self.window - self.gram

    @property
    def length(self) -> int:
        return 2 * self.reach + self.gram


WINDOW, GRAM = 400, 64
BYTES, WORDS = Grain(WINDOW, GRAM), Grain(51, 12)
GRAINS = (BYTES, WORDS)
REACH = BYTES.reach
BATCH = 4096
LARGE = 65536
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = 1 << 20
#: Bytes of texts whose words are hashed at once.
_CHUNK = 1 << 17


def run_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k bytes: a polynomial over a random value for each byte, by doubling, mixed at the end."""
    if len(a) < k:
        return np.empty(0, np.uint64)
    h, size, out, done = _VALUES[a], 1, None, 0
    while True:
        power = np.uint64(pow(int(_BASE), size, 1 << 64))
        if k & size:
            out = h if out is None else out[: len(a) - done - size + 1] * power + h[done : done + len(a) - done - size + 1]
            done += size
        if done == k:
            return mix(out[: len(a) - k + 1])
        h = h[:-size] * power + h[size:]
        size *= 2


def least_of(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours."""
    size, m = 1, h
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - size : w - size + len(h) - w + 1])


def chosen(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the runs that are the least of some w neighbours."""
    if len(h) < w:
        return np.empty(0, np.int64)
    least = least_of(h, w)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    size, m = 1, padded
    while size * 2 <= w:
        m = np.maximum(m[:-size], m[size:])
        size *= 2
    most = np.maximum(m[: len(h)], m[w - size : w - size + len(h)])
    return np.flatnonzero(h == most)


def _digest(part: bytes, left: int) -> int:
    return int.from_bytes(hashlib.blake2b(part, digest_size=8, salt=left.to_bytes(8, "little")).digest(), "little", signed=True)


def seeds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of each seed of a text, and the hash of its context; in pieces, so long texts need little memory.

    The last bit of a seed tells bytes (0) from words (1).
    """
    at, found = [], []
    n = len(data)
    for start in range(0, max(n - WINDOW + 1, 0), _STEP):
        lo, hi = max(0, start - WINDOW), min(n, start + _STEP + 2 * WINDOW)
        h = run_hashes(np.frombuffer(data, np.uint8, hi - lo, lo), GRAM)
        places = chosen(h, REACH + 1)
        last = start + _STEP >= n - WINDOW + 1  # no piece follows, so the rest belongs here
        places = places[(places + lo >= start) & (last | (places + lo < start + _STEP))]
        at.append(places + lo)
        found.append(h[places])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    places = np.concatenate(at)
    contexts = [_digest(data[(lo := max(0, p - REACH)) : p + GRAM + REACH], p - lo) for p in places.tolist()]
    return places, np.concatenate(found).view(np.int64) & ~1, np.array(contexts, np.int64)


def _grams(h: np.ndarray) -> np.ndarray:
    """Hash of each run of ``WORDS.gram`` (8 + 4) neighbours, by doubling."""
    two = mix(h[:-1] * _BASE + h[1:])
    four = mix(two[:-2] * _BASE + two[2:])
    eight = mix(four[:-4] * _BASE + four[4:])
    return mix(eight[:-4] * _BASE + four[8:])


def word_seeds(texts: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of words, and the same as ``seeds`` in words, of each text; some texts at a time are hashed end to end."""
    out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    nothing = np.empty(0, np.int64)
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= _CHUNK):
            size += len(texts[end]) + 1
            end += 1
        part = texts[start:end]
        h, at, _ = words(b" ".join(part), lower=False)
        bounds = np.searchsorted(at, np.cumsum([0] + [len(t) + 1 for t in part]))
        places = nothing
        if len(h) >= WORDS.window:
            g = _grams(h)
            # Runs across two texts are no runs: they are never the least.
            edges = bounds[1:-1]
            across = (edges[:, None] - np.arange(1, WORDS.gram)[None, :]).ravel()
            across = across[(across >= 0) & (across < len(g))]
            g[across] = np.uint64(0xFFFFFFFFFFFFFFFF)
            places = np.setdiff1d(chosen(g, WORDS.reach + 1), across)
        cuts = np.searchsorted(places, bounds)
        for k in range(len(part)):
            lo, hi = int(bounds[k]), int(bounds[k + 1])
            own = places[cuts[k] : cuts[k + 1]]
            if hi - lo < WORDS.window or not len(own):
                out.append((hi - lo, nothing, nothing, nothing))
                continue
            contexts = [_digest(h[(a := max(lo, p - WORDS.reach)) : min(hi, p + WORDS.gram + WORDS.reach)].tobytes(), p - a) for p in own.tolist()]
            out.append((hi - lo, own - lo, g[own].view(np.int64) | 1, np.array(contexts, np.int64)))
        start = end
    return out


def induce(groups: np.ndarray, text: np.ndarray, pad: int, grain: Grain, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """Starts of repeated strings: ``text`` has a column of ``length`` unit values (``pad`` outside) for each context.

    Returned: (contexts x reach + 1) flags, true where the string starting at that column stands in another row of the
    same group at the same column; with ``first`` and ``last`` (documents of each context), where it stands in two documents.
    """
    g = len(groups)
    out = np.zeros((g, grain.reach + 1), bool)
    order = np.argsort(groups, kind="stable")
    lcp = np.zeros(g, np.int32)
    # The sort keeps groups together, so their numbers stand still; 16 bits and less are sorted by radix.
    number = np.unique(groups, return_inverse=True)[1][order]
    number = number.astype(np.uint16 if number[-1] < 1 << 16 else np.int64)
    joined = number[1:] == number[:-1]
    for j in range(len(text) - 1, -1, -1):
        value_ = text[j][order]
        to = np.argsort(value_, kind="stable")
        to = to[np.argsort(number[to], kind="stable")]
        value_ = value_[to]
        same = np.flatnonzero(joined & (value_[1:] == value_[:-1]) & (value_[1:] != pad)) + 1
        low, high = to[same - 1] + 1, to[same]
        new = np.zeros(g, np.int32)
        if len(same):
            # Least common prefix over low..high, by tables of doubling length.
            gap = high - low + 1
            level = np.frexp(gap)[1] - 1
            value = np.empty(len(same), np.int32)
            table, size = lcp, 1
            for k in range(int(level.max()) + 1):
                here = np.flatnonzero(level == k)
                value[here] = np.minimum(table[low[here]], table[high[here] - size + 1])
                table, size = np.minimum(table[:-size], table[size:]), size * 2
            new[same] = value + 1
        order, lcp = order[to], new
        if j <= grain.reach:
            hit = lcp >= grain.window
            if not hit.any():
                continue
            starts = np.flatnonzero(~hit)  # neighbours with such a prefix form a run
            run = np.cumsum(~hit) - 1
            if first is None:
                found = np.diff(np.append(starts, g)) > 1
            else:
                found = np.minimum.reduceat(first[order], starts) < np.maximum.reduceat(last[order], starts)
                found &= np.diff(np.append(starts, g)) > 1
            out[order[found[run]], j] = True
    return out


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true values in each row as row, first, last."""
    step = np.diff(np.pad(flags.view(np.int8), ((0, 0), (1, 1))), axis=1)
    at, first = np.nonzero(step == 1)
    return at, first, np.nonzero(step == -1)[1] - 1


def _matrix(parts: pa.ChunkedArray, at: np.ndarray, lefts: np.ndarray, grain: Grain) -> tuple[np.ndarray, int]:
    """Unit values of the aligned contexts at some places (ascending), a column each, and the value that stands outside (no byte of UTF-8, no word's hash but one)."""
    kind = np.dtype(np.uint8 if grain == BYTES else np.uint64)
    pad = np.iinfo(kind).max
    out = np.empty((grain.length, len(at)), kind)
    column = np.arange(grain.length)
    done = offset = 0
    for chunk in parts.chunks:
        end = int(np.searchsorted(at, offset + len(chunk)))
        for a in range(done, end, BATCH):
            b = min(a + BATCH, end)
            taken = chunk.take(pa.array(at[a:b] - offset))
            ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] // kind.itemsize
            units = np.frombuffer(taken.buffers()[2], kind, int(ends[-1]))
            first = (grain.reach - lefts[a:b])[:, None]
            some = np.full((b - a, grain.length), pad, kind)
            some[(column >= first) & (column < first + np.diff(ends)[:, None])] = units[ends[0] :]
            out[:, a:b] = some.T
        done, offset = end, offset + len(chunk)
    return out, int(pad)


def find_seeds(documents: DataFrame, scratch: Scratch) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or b"" for t in pdf["text"]]
            by_words = word_seeds(texts)
            made = [tuple(np.concatenate(x) for x in zip(seeds(t), w[1:], strict=True)) for t, w in zip(texts, by_words, strict=True)]
            yield pd.DataFrame({"rid": pdf["rid"], "doc_id": pdf["doc_id"], "text": texts, "n_bytes": [len(t) for t in texts], "n_words": [w[0] for w in by_words], "sha": [hashlib.sha256(t).hexdigest() for t in texts], "pos": [p for p, _, _ in made], "seed": [h for _, h, _ in made], "context": [x for _, _, x in made]})

    rows = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("binary").alias("text"))
    return scratch.table(rows.mapInPandas(read, f"rid bigint, doc_id {kind}, text binary, n_bytes bigint, n_words bigint, sha string, pos array<int>, seed array<bigint>, context array<bigint>"), "seeds")


def extract(flagged: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents with repeated seeds, and the contexts to sort: rows with ``text`` or with ``seed, context, left, part, first, last``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                out.append((r.rid, r.text, None, None, None, None, None, None))
                h = None
                for x in r.places:
                    if x["mixed"] and (key := (x["seed"], x["context"])) not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(key)
                        grain = GRAINS[key[0] & 1]
                        lo, hi = max(0, x["pos"] - grain.reach), x["pos"] + grain.gram + grain.reach
                        if grain == WORDS and h is None:
                            h = words(r.text, lower=False)[0]
                        part = r.text[lo:hi] if grain == BYTES else h[lo:hi].tobytes()
                        out.append((None, None, *key, x["pos"] - lo, part, x["first"], x["last"]))
            names = ["rid", "text", "seed", "context", "left", "part", "first", "last"]
            columns = dict(zip(names, zip(*out, strict=True) if out else [()] * len(names), strict=True))
            yield pd.DataFrame({k: list(v) if k in ("text", "part") else pd.array(list(v), "Int64") for k, v in columns.items()})  # exact beside nulls

    return scratch.table(flagged.mapInPandas(read, "rid bigint, text binary, seed bigint, context bigint, left bigint, part binary, first bigint, last bigint"), "extracted")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def sort_groups(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """``seed, context, low, high`` of whole groups. ``held`` is emptied: contexts are let go once their units stand in columns."""
    rows = pa.concat_tables(held)
    held.clear()
    c, parts = {x: rows[x].to_numpy() for x in rows.column_names if x != "part"}, rows["part"]
    del rows
    made = []
    for k, grain in enumerate(GRAINS):
        at = np.flatnonzero(c["seed"] & 1 == k)
        if not len(at):
            continue
        new, other = _changes(c["group"][at], c["lo"][at]), _changes(c["seed"][at], c["context"][at])
        at, new = at[new | other], new[new | other]  # each context once
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        at, number = at[several], number[several]
        if len(at):
            made.append((grain, at, number, _matrix(parts, at, c["left"][at], grain)))
    del parts
    pa.default_memory_pool().release_unused()
    while made:
        grain, at, number, matrix = made.pop()
        flags = induce(number, *matrix, grain, *([c["first"][at], c["last"][at]] if grain == WORDS else [None, None]))
        del matrix
        column = np.arange(grain.reach + 1)
        for a in range(0, len(at), BATCH):
            here = at[a : a + BATCH]
            some = flags[a : a + BATCH] & (column >= c["lo"][here][:, None]) & (column < c["hi"][here][:, None])
            row, low, high = intervals(some)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c["seed"][here][row], c["context"][here][row], low, high)], ["seed", "context", "low", "high"])


def sort_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sort_groups`` over rows in the order of their groups, ``BATCH`` or one group at a time."""
    held: list[pa.Table] = []  # the last one's last group may go on
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = _changes(table["group"].to_numpy(), table["lo"].to_numpy())
        new[0] = bool(held) and any(held[-1][x][-1].as_py() != table[x][0].as_py() for x in ("group", "lo"))
        cut = np.flatnonzero(new)
        if count + table.num_rows >= BATCH and len(cut):
            held.append(table.slice(0, cut[-1]))
            table = table.slice(cut[-1])
            del batch
            yield from sort_groups(held)
            count = 0
        held.append(table)
        count += table.num_rows
        table = batch = None
    if held:
        yield from sort_groups(held)


def sort_contexts(contexts: DataFrame) -> DataFrame:
    """``seed, context, low, high``: columns where repeated strings start, by induced sorting in batches of groups.

    Rows ``group, lo, hi, seed, context, left, part, first, last``: a group's strings start in the columns lo to hi - 1.
    """

    return contexts.repartition("group", "lo").sortWithinPartitions("group", "lo", "seed", "context").mapInArrow(sort_batches, "seed bigint, context bigint, low bigint, high bigint")


def halves(rows: DataFrame) -> DataFrame:
    """Each row's columns in two halves; a half's group is the middle part that all strings starting there hold, ``full``
    all that they cover (null where the text ends before)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                grain = GRAINS[r.seed & 1]
                unit = 1 if grain == BYTES else 8
                mid, size = (r.lo + r.hi) // 2, len(r.part) // unit
                # The columns in which a whole string starts; the context's first unit stands in column reach - left.
                low, high = grain.reach - r.left, size - grain.window + grain.reach - r.left + 1
                for lo, hi in ((r.lo, mid), (mid, r.hi)):
                    if max(lo, low) < min(hi, high):
                        common = r.part[(hi - 1 - low) * unit : (lo + grain.window - low) * unit]
                        full = _digest(r.part[(lo - low) * unit : (hi - 1 + grain.window - low) * unit], hi) if lo >= low and hi <= high else None
                        out.append((_digest(common + r.seed.to_bytes(8, "little", signed=True), lo), lo, hi, r.seed, r.context, r.left, r.part, r.first, r.last, full))
            made = pd.DataFrame(out, columns=["group", "lo", "hi", "seed", "context", "left", "part", "first", "last", "full"])
            yield made.assign(full=pd.array([x[-1] for x in out], "Int64"))

    plain = rows.select("group", "lo", "hi", "seed", "context", "left", "part", "first", "last")
    return plain.mapInPandas(work, "group bigint, lo int, hi int, seed bigint, context bigint, left bigint, part binary, first bigint, last bigint, full bigint")


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs and the digest of what stays, for spans (start, end) in any order."""
    kept, at, removed, runs, last = hashlib.sha256(), 0, 0, 0, -1
    for s, e in sorted(spans):
        if s > last:
            runs += 1
        if e <= at:
            continue
        if s > at:
            kept.update(data[at:s])
        removed += e - max(s, at)
        at = last = max(at, e)
    kept.update(data[at:])
    return removed, runs, kept.hexdigest()


def units(spans: list[tuple[int, int]]) -> int:
    """Units that spans (start, end) cover."""
    total, at = 0, 0
    for s, e in sorted(spans):
        total += max(0, e - max(s, at))
        at = max(at, e)
    return total


def solve(contexts: DataFrame, large: DataFrame, scratch: Scratch) -> DataFrame:
    """``seed, context, low, high`` of all contexts to sort; ``large`` names the seeds that are split first."""
    whole = F.when(F.col("seed").bitwiseAND(1) == 0, F.lit(BYTES.reach)).otherwise(F.lit(WORDS.reach)) + 1
    rows = contexts.select(F.col("seed").alias("group"), F.lit(0).alias("lo"), whole.alias("hi"), "seed", "context", "left", "part", "first", "last")
    if large.isEmpty():
        return sort_contexts(rows)
    few = _bounded(large.select(F.col("seed").alias("_seed")))
    out, level = sort_contexts(rows.join(few, F.col("seed") == F.col("_seed"), "left_anti")), 0
    now = rows.join(few, F.col("seed") == F.col("_seed"), "left_semi")
    two = (F.col("seed").bitwiseAND(1) == 0) | (F.col("_first") < F.col("_last"))
    bounds = [F.min("first").alias("_first"), F.max("last").alias("_last")]
    while True:
        now = scratch.table(halves(now), f"halves-{level}")
        # Those that agree in all that their columns' strings cover are done; one goes on for all of them.
        alike = now.where("full is not null").groupBy(F.col("group").alias("_group"), F.col("lo").alias("_lo"), F.col("full").alias("_full"))
        alike = scratch.table(alike.agg(F.count(F.lit(1)).alias("members"), F.min("context").alias("_one"), *bounds).where("members > 1"), f"alike-{level}")
        on = (F.col("group") == F.col("_group")) & (F.col("lo") == F.col("_lo")) & (F.col("full") == F.col("_full"))
        joined = scratch.table(now.join(_bounded(alike), on, "left"), f"joined-{level}")
        done = joined.where(F.col("_full").isNotNull() & two).select("seed", "context", F.col("lo").cast("long").alias("low"), (F.col("hi") - 1).cast("long").alias("high"))
        out = out.unionByName(done)
        rest = joined.where("_full is null or context = _one").withColumn("first", F.coalesce("_first", "first")).withColumn("last", F.coalesce("_last", "last"))
        rest = rest.select("group", "lo", "hi", "seed", "context", "left", "part", "first", "last")
        sizes = rest.groupBy(F.col("group").alias("_group"), F.col("lo").alias("_lo")).agg(F.count(F.lit(1)).alias("members"))
        big = scratch.table(sizes.where((F.col("members") > LARGE)).select("_group", "_lo"), f"large-{level}")
        if big.isEmpty():
            return out.unionByName(sort_contexts(rest))
        big = _bounded(big)
        on = (F.col("group") == F.col("_group")) & (F.col("lo") == F.col("_lo"))
        out = out.unionByName(sort_contexts(rest.join(big, on, "left_anti")))
        now, level = rest.join(big, on, "left_semi"), level + 1


def repeated_spans(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (rid, doc_id, n_bytes, sha), texts of rows with repeated seeds, and (rid, spans: array of grain, start, end)."""
    found = find_seeds(documents.select("doc_id", "text"), scratch)
    grain = F.col("seed").bitwiseAND(1)
    places = found.select("rid", "n_bytes", "n_words", F.explode(F.arrays_zip("pos", "seed", "context")).alias("p")).select("rid", "n_bytes", "n_words", "p.*")
    repeated = places.groupBy("seed").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    held = bitmaps.holding(places, "seed", scratch.table(bitmaps.pages(repeated, "seed"), "repeated"))
    held = scratch.table(held.select("rid", F.when(grain == 0, F.col("n_bytes")).otherwise(F.col("n_words")).alias("n"), "pos", "seed", "context"), "held")
    kinds = held.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("times"), F.min("rid").alias("first"), F.max("rid").alias("last"))
    kinds = scratch.table(kinds, "kinds")
    per = kinds.groupBy(F.col("seed").alias("_seed")).agg(F.count(F.lit(1)).alias("contexts"), F.sum("times").alias("all"), F.min("first").alias("_first"), F.max("last").alias("_last"))
    # Bytes: two places anywhere. Words: two documents.
    per = scratch.table(per.where(F.when(F.col("_seed").bitwiseAND(1) == 0, F.col("all") > 1).otherwise(F.col("_first") < F.col("_last"))).select("_seed", "contexts"), "per-seed")
    full = F.when(grain == 0, F.col("times") > 1).otherwise(F.col("first") < F.col("last"))
    kinds = kinds.join(per, F.col("seed") == F.col("_seed")).select("_seed", F.col("context").alias("_context"), "contexts", "first", "last", full.alias("full"))
    hits = scratch.table(held.join(kinds, (F.col("seed") == F.col("_seed")) & (F.col("context") == F.col("_context"))).drop("_seed", "_context"), "hits")
    scratch.drop("repeated", "held", "kinds")
    # A context is taken from the first document that has it.
    mixed = (F.col("contexts") > 1) & (F.col("rid") == F.col("first"))
    listed = hits.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("pos", "seed", "context", mixed.alias("mixed"), "first", "last")).alias("places"))
    texts = bitmaps.holding(found.select("rid", "text"), "rid", scratch.table(bitmaps.pages(hits, "rid"), "hit-rows"))
    extracted = extract(texts.join(listed, F.col("rid") == F.col("_rid")).drop("_rid"), scratch)
    rows = scratch.table(found.select("rid", "doc_id", "n_bytes", "sha"), "rows")
    scratch.drop("seeds", "hit-rows")
    contexts = extracted.where("seed is not null").select("seed", "context", "left", "part", "first", "last")
    solved = scratch.table(solve(contexts, per.where(F.col("contexts") > LARGE).select(F.col("_seed").alias("seed")), scratch), "solved")
    reach = F.when(grain == 0, F.lit(BYTES.reach)).otherwise(F.lit(WORDS.reach))
    window = F.when(grain == 0, F.lit(BYTES.window)).otherwise(F.lit(WORDS.window))
    # Strings around a place start at the columns that its document has room for.
    whole = hits.where("full").select("rid", grain.alias("grain"), F.greatest(F.col("pos") - reach, F.lit(0)).cast("long").alias("s"), (F.least(F.col("pos"), F.col("n") - window) + window).cast("long").alias("e")).where((F.col("e") - F.col("s")) >= F.when(F.col("grain") == 0, BYTES.window).otherwise(WORDS.window))
    solved = solved.select(F.col("seed").alias("_seed"), F.col("context").alias("_context"), "low", "high")
    part = hits.where("not full and contexts > 1").join(solved, (F.col("seed") == F.col("_seed")) & (F.col("context") == F.col("_context")))
    start = F.col("pos") - reach
    part = part.select("rid", grain.alias("grain"), (start + F.col("low")).alias("s"), (start + F.col("high") + window).alias("e"))
    spans = whole.unionByName(part).groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("grain", "s", "e")).alias("spans"))
    return rows, extracted.where("rid is not null").select("rid", "text"), spans


def dedup(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words`` of every row."""
    scratch = Scratch(documents.sparkSession, "suffix")
    rows, texts, spans = repeated_spans(documents, scratch)

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [cut(t, [(x["s"], x["e"]) for x in spans if not x["grain"]]) for t, spans in zip(pdf["text"], pdf["spans"], strict=True)]
            shared = [units([(x["s"], x["e"]) for x in spans if x["grain"]]) for spans in pdf["spans"]]
            yield pd.DataFrame({"rid": pdf["rid"], "n_removed": [m[0] for m in made], "n_spans": [m[1] for m in made], "kept": [m[2] for m in made], "shared": shared})

    done = texts.join(spans, F.col("rid") == F.col("_rid")).drop("_rid").mapInPandas(remove, "rid bigint, n_removed bigint, n_spans bigint, kept string, shared bigint")
    out = rows.join(done, "rid", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("shared", zero).alias("n_shared_words"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same rows in DuckDB's SQL: digests of all strings, over hexadecimal texts (two signs a byte)."""
    w, k = WINDOW, WORDS.window
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, md5_number(substring(h, (2 * i + 1)::BIGINT, {2 * WINDOW})) AS x FROM (SELECT r, h, unnest(range(len(h) // 2 - {w - 1})) AS i FROM d)),
t AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY x) > 1)),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + {w} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM t),
u AS (SELECT r, min(i) AS a, max(i) + {w} AS e FROM g GROUP BY r, k),
v AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM u),
q AS (SELECT r, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, (2 * p + 1)::BIGINT, (2 * (a - p))::BIGINT), '' ORDER BY a) || substring(any_value(h), (2 * max(e) + 1)::BIGINT) AS kept FROM v JOIN d USING (r) GROUP BY r),
ws AS (SELECT r, i, md5_number(array_to_string(w[i:i + {k - 1}], ' ')) AS x FROM (SELECT r, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d)),
wt AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM ws JOIN (SELECT x FROM ws GROUP BY x HAVING min(r) < max(r)) USING (x)),
wu AS (SELECT r, sum(CASE WHEN p IS NULL THEN {k} ELSE least({k}, i - p) END)::BIGINT AS n_shared_words FROM wt GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(n_shared_words, 0) AS n_shared_words FROM d LEFT JOIN q USING (r) LEFT JOIN wu USING (r)"""
