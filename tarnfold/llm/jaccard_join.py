"""N-gram Jaccard join: an exact join in the metric space of shingle sets, by pivots, Voronoi regions and windows.

1. Texts with equal sets form a class; one member stands for it. Class ids are 64-bit sums over a set's mixed hashes; a
   second such sum beside them tells unlike sets apart that share an id, so only 128 equal bits make a class.
2. Between unlike texts every Jaccard distance is 1, so pivots drawn from the whole corpus would tell nothing apart.
   The first pivots are therefore chosen through shared shingles: sets A and B with J(A, B) >= t share one of the first
   ``n - ceil(t n) + 1`` shingles of each, in any common order (rare ones first, by a corpus-wide count sketch; its ranks
   part counts by less than a tenth, so a shared passage still shows where unlike shingles fill every cell). All
   classes that hold such an anchor form a region around one of them, so each linked pair meets in a region. Profiles
   (shingle counts in buckets, which differ by no more than the sets) split regions that only share a passage.
3. Distance to a pivot obeys the triangle inequality. In a region of more than ``LEAF`` members, ``PIVOTS`` members
   become pivots; a member's home is its nearest pivot p. With e = 1 - t, a partner y of a member x whose home is p has
   d(y, p) <= d(y, home of y) + 2 e: y is replicated into every cell within this window. Members with no pivot nearer
   than 1 - e have no home; they meet in a cell of their own with those beyond 1 - 2 e. Members within e of a pivot are
   linked to it, and to each other through it, so a cell of such members only is finished; else only those are kept
   whose distance to the pivot lets them reach one of the others. Cells are joined in the same way again.
4. Regions of at most ``LEAF`` members are joined inside a task by the same steps, pivots, cells and windows, down to
   ``FEW`` members or cells that windows no longer shrink, whose sets meet directly.
   Cells that overlap so much that together they meet more pairs than their members have become one region again, whose
   members meet directly: no level has more pairs than the one above it.
5. Larger cells that windows no longer shrink (more than ``SHRINK`` of their parent, or deeper than ``DEPTH``) are cut
   into blocks and joined block against block: exact too, but the work grows with the square of such a cell's members.
   Regions of more than ``PRUNE`` members go to the pivots without a look at the profiles: that changes work only.

What moves between executors: the least and greatest class of each anchor; a bitmap of those with two classes
(``bitmaps.BITS``; copies of one class set no bit) then lets little more than those through to their regions; profiles and
texts move for the classes that a region still holds.

Only a spanning forest of the links leaves a region; components follow by star steps. A region's members are dealt out
in parts of ``PART`` with a copy of the pivots, so no group meets in one task, and nothing is capped or dropped.

Defined results: null and empty texts have an empty set, no links and their own id; a text of fewer than five words has
its whole sequence as one shingle; copies are linked; repeated rows appear each; null ids are never the smallest
(a class of null ids only has a null component); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm import bitmaps
from tarnfold.llm.components import connected_components
from tarnfold.llm.scratch import Scratch
from tarnfold.llm.words import mix, shingles

PERCENT = 80
LEAF = 192
#: Sets that meet directly.
FEW = 8
PIVOTS = 12
PART = 256
DEPTH = 6
#: A cell with more than this share of its parent's members is joined in blocks.
SHRINK = 0.7
SKETCH_BITS = 22
PROFILE = 128
#: Ranks of counts for every doubling: 8 bits hold counts to 2**32.
RANKS = 7.9
#: Indices of the sketch that a task gathers before it counts them.
GATHERED = 1 << 20
#: Larger regions go to the pivots without a look at the profiles.
PRUNE = 1024
#: Members of a block where blocks are joined.
BLOCK = 512
#: Members of small regions for each task that joins them.
TASK_ROWS = 1024
#: Rows of a few numbers that are broadcast to the texts, 10 MB or so; more are shuffled with them.
SENT_ROWS = 200_000
_CHUNK_BITS = 16


def class_id(s: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> int:
    """Signed 64-bit id of a set of shingles."""
    return int(np.sum(mix(s ^ np.uint64(salt)), dtype=np.uint64).astype(np.int64))


def check_id(s: np.ndarray) -> int:
    """A second id, independent of the first."""
    return class_id(s, 0x14057B7EF767814F)


def linked(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    return 100 * inter >= percent * (a + b - inter)


def profile(s: np.ndarray) -> np.ndarray:
    """Number of a set's shingles in each of its buckets, 255 at most; profiles differ by no more than the sets do.

    A power of two of buckets, about a quarter of the set's size: so also large unlike sets differ by enough.
    """
    buckets = max(PROFILE, 1 << max(len(s) // 4, 1).bit_length() - 1)
    return np.minimum(np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def folded(p: np.ndarray, buckets: int) -> np.ndarray:
    """The same counts in fewer buckets (the last axis); still no two differ by more than the sets."""
    return p.reshape(*p.shape[:-1], -1, buckets).sum(axis=-2, dtype=np.int32) if p.shape[-1] != buckets else p.astype(np.int32)


class Union:
    """Disjoint sets over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections of a bounded number of sets."""
    m = len(sets)
    if m == 2:
        k = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), k], [k, len(sets[1])]])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    shared = np.bincount(column)[column] > 1
    owner = owner[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    out = np.zeros((m, m), np.float32)
    width = 8192
    for start in range(0, int(column.max()) + 1 if len(column) else 0, width):
        a, e = np.searchsorted(column, [start, start + width])
        x = np.zeros((m, width), np.float32)
        x[owner[a:e], column[a:e] - start] = 1
        out += x @ x.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _direct(members: list[int], sets: list[np.ndarray], near: Union, side: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Links of some members with each other that connect what ``near`` doesn't yet; ``side`` lets only unlike sides meet."""
    own = [sets[i] for i in members]
    n = np.array([len(s) for s in own], np.int64)
    ok = linked(intersections(own), n[:, None], n[None, :])
    if side is not None:
        sides = np.array([side[i] for i in members])
        ok &= sides[:, None] != sides[None, :]
    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        if near.join(members[int(i)], members[int(j)]):
            yield members[int(i)], members[int(j)]


def _overlaps(pivot: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one set with each of several, laid end to end."""
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), starts)


def _by_pivots(sets: list[np.ndarray], near: Union) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of a task's region: pivots, Voronoi cells with their windows, cells joined again."""
    e = 1 - PERCENT / 100
    size = np.array([len(s) for s in sets], np.int64)
    todo = [(list(range(len(sets))), 1 << 62)]
    while todo:
        members, was = todo.pop()
        m = len(members)
        if m < 2:
            continue
        if m <= FEW or m > SHRINK * was:
            yield from _direct(members, sets, near)
            continue
        # Members that nothing is connected to yet make the better pivots; those evenly spaced in order of size.
        spread = sorted(members, key=lambda i: (near.root(i) != i, size[i], i))
        count = min(PIVOTS, max(2, m // FEW))
        pivots = sorted({spread[k * (m - 1) // max(count - 1, 1)] for k in range(count)})
        rest = [i for i in members if i not in pivots]
        flat, n = np.concatenate([sets[i] for i in rest]), size[rest]
        starts = np.cumsum(n) - n
        inter = np.stack([_overlaps(sets[p], flat, starts) for p in pivots])
        sizes = size[pivots][:, None]
        d = 1 - inter / (n + sizes - inter)
        yield from _direct(pivots, sets, near)
        for k, j in zip(*np.nonzero(linked(inter, n, sizes)), strict=True):
            if near.join(pivots[int(k)], rest[int(j)]):
                yield pivots[int(k)], rest[int(j)]
        home = d.min(axis=0)
        root = np.array([near.root(i) for i in rest])
        cells = [np.flatnonzero(home >= 1 - 2 * e - 1e-9)]
        for k, p in enumerate(pivots):
            inside = (d[k] < 1) & (d[k] <= home + 2 * e + 1e-9)
            core = root == near.root(p)
            if (open_ := inside & ~core).any():
                low, high = d[k][open_].min(), d[k][open_].max()
                inside &= ~core | ((d[k] >= low - e - 1e-9) & (d[k] <= high + e + 1e-9))
                cells.append(np.flatnonzero(inside))
        every = np.unique(np.concatenate(cells))
        if sum(len(c) ** 2 for c in cells) > len(every) ** 2:
            yield from _direct([rest[int(j)] for j in every], sets, near)  # cells that repeat each other: once is enough
        else:
            todo += [([rest[int(j)] for j in c], m) for c in cells]


def region_links(ids: list[int], roots: list[int], sets: list[np.ndarray], side: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of a region's links; ``roots`` tells what is connected already, ``side`` parts two blocks."""
    near, first = Union(len(ids)), {}
    for i, r in enumerate(roots):
        near.join(i, first.setdefault(r, i))
    found = _by_pivots(sets, near) if side is None else _direct(list(range(len(ids))), sets, near, side)
    for i, j in found:
        yield ids[i], ids[j]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal keys; a group is bounded by the caller's plan."""
    at, held = None, []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            key = tuple(getattr(row, k) for k in keys)
            if key != at:
                if held:
                    yield at, held
                at, held = key, []
            held.append(row)
    if held:
        yield at, held


def ranks(totals: np.ndarray) -> np.ndarray:
    """Logarithms of counts in one byte each."""
    return (RANKS * np.log2(totals + 1.0)).astype(np.uint8)


def describe(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n, cid, check`` of every row, and for each bucket of shingles the rank of its count in the corpus."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, held, size = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        for pdf in batches:
            n, ids, checks = [], [], []
            for text in pdf["text"]:
                s = shingles(text or b"")
                n.append(len(s))
                ids.append(class_id(s) if len(s) else None)
                checks.append(check_id(s) if len(s) else None)
                held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                size += len(s)
                if size >= GATHERED:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
                    held, size = [], 0
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": n, "cid": pd.array(ids, "Int64"), "check": pd.array(checks, "Int64"), "chunk": None, "counts": None})
        if size:
            counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
        if counts.any():
            parts = counts.reshape(-1, 1 << _CHUNK_BITS)
            yield pd.DataFrame({"doc_id": None, "n": 0, "cid": None, "check": None, "chunk": range(len(parts)), "counts": [zlib.compress(p.tobytes(), 1) for p in parts]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << _CHUNK_BITS, np.float64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "logs": [ranks(total).tobytes()]})

    made = documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(read, f"doc_id {kind}, n bigint, cid bigint, check bigint, chunk int, counts binary")
    table = scratch.table(made, "described")
    # A row for each task and chunk; the sums have 2**SKETCH_BITS bytes whatever the input.
    logs = np.zeros(1 << SKETCH_BITS, np.uint8).reshape(-1, 1 << _CHUNK_BITS)
    for r in table.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInPandas(add, "chunk int, logs binary").collect():
        logs[r["chunk"]] = np.frombuffer(r["logs"], np.uint8)
    return table.where("chunk is null").select("doc_id", "n", "cid", "check"), logs.reshape(-1)


def _keyed(documents: DataFrame) -> DataFrame:
    """``text, one, two``: whole texts as bytes, with a key of 128 bits."""
    text = F.col("text").cast("binary")
    return documents.select(text.alias("text"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"))


def with_anchors(documents: DataFrame, logs: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """``cid, check, n, anchors, profile, one, two``: a task's classes, each once, with the key of one of its texts."""
    shared = documents.sparkSession.sparkContext.broadcast(logs)  # 2**SKETCH_BITS bytes

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, seen = shared.value, set()
        for pdf in batches:
            out = []
            for text, one, two in zip(pdf["text"], pdf["one"], pdf["two"], strict=True):
                s = shingles(text or b"")
                if not len(s) or (cid := (class_id(s), check_id(s))) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(cid)
                prefix = len(s) - -(-percent * len(s) // 100) + 1
                if prefix < len(s):
                    order = np.lexsort((s, rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    anchors = s[order[:prefix]]
                else:
                    anchors = s
                out.append((*cid, len(s), anchors.view(np.int64), profile(s).tobytes(), one, two))
            yield pd.DataFrame(out, columns=["cid", "check", "n", "anchors", "profile", "one", "two"])

    return _keyed(documents).mapInPandas(read, "cid bigint, check bigint, n bigint, anchors array<bigint>, profile binary, one bigint, two bigint")


def shared_anchors(anchored: DataFrame, scratch: Scratch) -> DataFrame:
    """``anchor, region`` of the anchors that two classes hold, however many rows a class has; the least one names the region."""
    ends = anchored.groupBy("anchor").agg(F.min("cid").alias("region"), F.max("cid").alias("last"))
    return scratch.table(ends.where("region <> last").select("anchor", "region"), "leaders")


def texts_of(documents: DataFrame, classes: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """``cid, text`` of the classes of ``kept``, at least once each and at most once a task."""
    held = bitmaps.holding(classes.select("cid", "one", "two"), "cid", scratch.table(bitmaps.pages(kept, "cid"), "kept-ids"))
    one = held.groupBy("cid").agg(F.min(F.struct("one", "two")).alias("key")).join(kept.select("cid").distinct(), "cid")
    one = scratch.table(one.select("cid", F.col("key.one").alias("_one"), F.col("key.two").alias("_two")), "keys")
    found = bitmaps.holding(_keyed(documents), "one", scratch.table(bitmaps.pages(one, "_one"), "kept-keys"))
    found = found.join(_bounded(one), (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))).select("cid", "text")

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            fresh = ~(pdf["cid"].duplicated() | pdf["cid"].isin(seen))
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(pdf["cid"])
            yield pdf[fresh]

    return found.mapInPandas(once, "cid bigint, text binary")


def apart(df: DataFrame, clash: DataFrame) -> DataFrame:
    """Unlike sets with one id (some hundred among 1e11) get an id of both sums; ``clash``: such ids."""
    marked = clash.select(F.col("cid").alias("_clash"))
    cid = F.when(F.col("_clash").isNotNull(), F.xxhash64("cid", "check")).otherwise(F.col("cid"))
    return df.join(marked, F.col("cid") == F.col("_clash"), "left").withColumn("cid", cid).drop("_clash")


def _bounded(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row, broadcast if a count shows that it is small, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _sorted_rows(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    return rows.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys, *order)


def _stream(f: Callable, schema: str, rows: DataFrame) -> DataFrame:
    return rows.mapInPandas(f, schema)


def _near(p: np.ndarray, q: np.ndarray, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    """Rows whose sizes and profiles (of as many buckets) let the sets be linked."""
    t = PERCENT / 100
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (np.abs(p.astype(np.int32) - q).sum(axis=-1) <= (1 - t) / (1 + t) * (n + m) + 1e-6)


def merge_regions(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """Regions whose leaders stand in each other's regions with like profiles become one: copies share one region.

    A region may be joined with any other without loss, so nothing depends on the choice but the work.
    """
    leaders = members.select(F.col("region").alias("cid")).distinct()
    pairs = members.where("region <> cid").join(leaders, "cid", "left_semi").select("cid", "region")
    one = profiles.select(F.col("_cid").alias("cid"), F.col("profile").alias("p"), F.col("_n").alias("n"))
    two = profiles.select(F.col("_cid").alias("region"), F.col("profile").alias("q"), F.col("_n").alias("m"))
    pairs = pairs.join(one, "cid").join(two, "region")

    def like(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for p, q, n, m in zip(pdf["p"], pdf["q"], pdf["n"], pdf["m"], strict=True):
                buckets = min(len(p), len(q))
                p, q = (folded(np.frombuffer(x, np.uint8), buckets) for x in (p, q))
                keep.append(bool(_near(p, q, n, m)))
            yield pdf.loc[keep, ["cid", "region"]]

    to = pairs.mapInPandas(like, "cid bigint, region bigint").groupBy("cid").agg(F.min("region").alias("to"))
    first = to.select(F.col("cid").alias("a"), F.col("to").alias("b"))
    jump = to.select(F.col("cid").alias("b"), F.col("to").alias("c"))
    moved = first.join(jump, "b", "left").select(F.col("a").alias("region"), F.coalesce("c", "b").alias("_to"))
    return members.join(moved, "region", "left").select(F.coalesce("_to", "region").alias("region"), "cid").distinct()


def _alike(profiles: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a bounded number of sets whose sizes and profiles let them be linked."""
    kinds: dict[int, list[int]] = {}
    for i, p in enumerate(profiles):
        kinds.setdefault(len(p), []).append(i)
    for buckets, own in kinds.items():
        # Linked sets' sizes differ by a quarter at most, so their profiles by one doubling.
        tables = [(np.array(rows), np.stack([folded(profiles[i], buckets) for i in rows])) for rows in (own, kinds.get(2 * buckets, [])) if rows]
        for k, i in enumerate(own):
            for rows, table in tables:
                start = k + 1 if rows[0] == own[0] else 0
                for j in np.flatnonzero(_near(table[start:], folded(profiles[i], buckets), sizes[rows[start:]], sizes[i])):
                    yield i, int(rows[start + j])


def prune(rows: DataFrame) -> DataFrame:
    """Splits regions of at most PRUNE members by what profiles rule out: rows ``region, cid, n, profile`` to ``region, cid``.

    Linked sets A, B differ in at most (|A| + |B|) / 9 shingles (for t = 0.8), their profiles in no more. Members that
    no chain of such pairs connects go apart, lonely ones go; parts with the same members become one region.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for_all = []
        for _, group in _groups(batches, ["region"]):
            once = list({r.cid: r for r in group}.values())
            near = Union(len(once))
            for i, j in _alike([np.frombuffer(r.profile, np.uint8) for r in once], np.array([r.n for r in once], np.int64)):
                near.join(i, j)
            parts: dict[int, list] = {}
            for i, r in enumerate(once):
                parts.setdefault(near.root(i), []).append(r)
            for part in parts.values():
                if len(part) > 1:
                    region = class_id(np.array([r.cid for r in part], np.int64).view(np.uint64))
                    for_all += [(region, r.cid) for r in part]
            if len(for_all) > 10_000:
                yield pd.DataFrame(for_all, columns=["region", "cid"])
                for_all = []
        yield pd.DataFrame(for_all, columns=["region", "cid"], dtype="int64")

    return _stream(work, "region bigint, cid bigint", _sorted_rows(rows, ["region"], ["cid"])).distinct()


def join_leaves(rows: DataFrame, count: int = 0) -> DataFrame:
    """Edges ``a, b`` of regions of bounded size: rows ``region, root, cid, side, text``, sides below 0 unless two blocks meet.

    ``count`` rows go to a task for every TASK_ROWS and to all cores at least: few bytes are much work here.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for _, group in _groups(batches, ["region"]):
            once = list({r.cid: r for r in group}.values())
            if len(once) > 1:
                sides = None if once[0].side < 0 else [r.side for r in once]
                out += region_links([r.cid for r in once], [r.root for r in once], [shingles(r.text) for r in once], sides)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return _stream(work, "a bigint, b bigint", _sorted_rows(rows, ["region"], ["cid"], max(2 * rows.sparkSession.sparkContext.defaultParallelism, count // TASK_ROWS)))


def to_pivots(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Distances to a region's pivots: ``region, cid, root, near, far, cells, d``.

    ``members``: region, part, cid, root, text. ``pivots``: region, part, cid, text, for every part of the region.
    ``near``: pivots linked to the member; ``cells`` and ``d``: pivots within the window and the distances to them;
    ``far``: no pivot is nearer than 1 - 2 e.
    """
    e = 1 - PERCENT / 100
    both = pivots.select("region", "part", F.lit(0).alias("kind"), "cid", F.lit(0).cast("long").alias("root"), "text").unionByName(
        members.select("region", "part", F.lit(1).alias("kind"), "cid", "root", "text")
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, last = None, [], None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.region, r.part) != at:
                    at, held, last = (r.region, r.part), [], None
                if (r.kind, r.cid) == last:
                    continue  # the same class from another task
                last = (r.kind, r.cid)
                s = shingles(r.text)
                if r.kind == 0:
                    held.append((r.cid, s))
                    continue
                inter = np.array([len(np.intersect1d(s, p, assume_unique=True)) for _, p in held])
                sizes = np.array([len(p) for _, p in held])
                d = 1 - inter / (len(s) + sizes - inter)
                ok = linked(inter, len(s), sizes)
                home = int(np.argmin(d))
                near = [k for k in range(len(held)) if ok[k]]
                cells = [k for k in range(len(held)) if d[k] < 1 and d[k] <= d[home] + 2 * e + 1e-9]
                out.append((r.region, r.cid, r.root, sorted(held[k][0] for k in near), bool(d[home] >= 1 - 2 * e - 1e-9), [held[k][0] for k in cells], [float(d[k]) for k in cells]))
            yield pd.DataFrame(out, columns=["region", "cid", "root", "near", "far", "cells", "d"])

    return _stream(work, "region bigint, cid bigint, root bigint, near array<bigint>, far boolean, cells array<bigint>, d array<double>", _sorted_rows(both, ["region", "part"], ["kind", "cid"]))


def _sized(regions: DataFrame) -> DataFrame:
    sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
    return regions.join(sizes, "region")


def join_regions(regions: DataFrame, texts: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Edge tables of all regions: rows ``region, cid, root`` (root: what a member is known to be linked to)."""
    edges: list[DataFrame] = []
    texts = texts.select(F.col("cid").alias("_cid"), "text")

    def told(df: DataFrame) -> DataFrame:
        return texts.join(_bounded(df), F.col("cid") == F.col("_cid")).drop("_cid")

    level = 0
    while True:
        sized = scratch.table(_sized(regions), f"regions-{level}")
        scratch.drop(f"cells-{level - 1}")
        small = sized.where(F.col("members").between(2, LEAF)).withColumn("side", F.lit(-1))
        edges.append(scratch.table(join_leaves(told(small).select("region", "root", "cid", "side", "text"), small.count()), f"edges-{level}"))
        large = sized.where(F.col("members") > LEAF)
        if large.isEmpty():
            return edges
        stuck = large.where((F.col("members") > SHRINK * F.col("was")) | F.lit(level >= DEPTH))
        if not stuck.isEmpty():
            met = blocks(stuck)
            edges.append(scratch.table(join_leaves(told(met), met.count()), f"edges-blocks-{level}"))
        large = large.where((F.col("members") <= SHRINK * F.col("was")) & F.lit(level < DEPTH))
        if large.isEmpty():
            return edges
        pick = Window.partitionBy("region").orderBy(F.col("fresh").desc(), F.xxhash64("cid", F.lit(level)), "cid")
        pivots = large.select("region", "cid", "members", (F.col("root") == F.col("cid")).alias("fresh")).withColumn("i", F.row_number().over(pick)).where(F.col("i") <= PIVOTS)
        pivots = told(pivots.select("region", "members", "cid")).dropDuplicates(["region", "cid"])
        parts = F.ceil(F.col("members") / PART).cast("int")
        pivots = pivots.select("region", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "cid", "text")
        dealt = told(large.withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int")))
        measured = scratch.table(to_pivots(dealt, pivots), f"measured-{level}")
        edges.append(measured.select(F.col("cid").alias("a"), F.explode("near").alias("b")).where("a <> b"))
        regions = next_cells(measured, scratch.table(pivot_roots(measured), f"roots-{level}"), large.select("region", "members").distinct())
        regions = uncrowded(scratch.table(regions, f"cells-{level}"))
        level += 1


def pivot_roots(measured: DataFrame) -> DataFrame:
    """``region, pivot, root``: pivots that common partners connect; at most PIVOTS squared rows a region are summed up."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {x: i for i, x in enumerate(ids)}
        near = Union(len(ids))
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            near.join(at[a], at[b])
        return pd.DataFrame({"region": pdf["region"].iloc[0], "pivot": ids, "proot": [ids[near.root(i)] for i in range(len(ids))]})

    both = measured.where(F.size("near") > 1).select("region", F.col("near")[0].alias("a"), F.explode(F.slice("near", 2, PIVOTS)).alias("b")).distinct()
    return both.groupBy("region").applyInPandas(work, "region bigint, pivot bigint, proot bigint")


def next_cells(measured: DataFrame, roots: DataFrame, parents: DataFrame) -> DataFrame:
    """The cells that still need a join, as regions; a member's root is a node it is known to be connected to.

    Pivots have met every member, so they are done. In a cell, members connected to its pivot need no join with each
    other; they stay only where the distances to the pivot let them reach one of the rest.
    """
    e = 1 - PERCENT / 100
    named = roots.select(F.col("region").alias("_region"), F.col("pivot").alias("_pivot"), "proot")

    def rooted(df: DataFrame, pivot: str) -> DataFrame:
        on = (F.col("region") == F.col("_region")) & (F.col(pivot) == F.col("_pivot"))
        return df.join(named, on, "left").withColumn("proot", F.coalesce("proot", pivot)).drop("_region", "_pivot")

    left = measured.where(~F.array_contains("near", F.col("cid"))).withColumn("first", F.when(F.size("near") > 0, F.col("near")[0]))
    left = rooted(left, "first").withColumn("newroot", F.coalesce("proot", "root")).drop("proot", "first")
    inside = left.select("region", "cid", F.col("newroot").alias("root"), F.explode(F.arrays_zip("cells", "d")).alias("c"))
    inside = rooted(inside.select("region", "cid", "root", F.col("c.cells").alias("pivot"), F.col("c.d").alias("d")), "pivot")
    inside = inside.select(F.col("region").alias("parent"), F.xxhash64("region", "pivot").alias("region"), "cid", "root", "d", (F.col("root") == F.col("proot")).alias("core"))
    rest = inside.where(~F.col("core")).groupBy("region").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    inside = inside.join(rest, "region").where(~F.col("core") | F.col("d").between(F.col("low") - e - 1e-9, F.col("high") + e + 1e-9))
    none = left.where("far").select(F.col("region").alias("parent"), F.xxhash64("region", F.lit("none")).alias("region"), "cid", F.col("newroot").alias("root"))
    cells = inside.select("parent", "region", "cid", "root").unionByName(none)
    open_ = cells.groupBy("region").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("region")
    return cells.join(open_, "region").join(parents.select(F.col("region").alias("parent"), F.col("members").alias("was")), "parent")


def uncrowded(cells: DataFrame) -> DataFrame:
    """``region, cid, root, was``: cells that would meet more pairs than all of their members have become one region.

    A member stands in every cell within its window, so cells of sets that lie equally far from all pivots repeat each
    other, level by level. Their members meet once instead: ``was`` 0 sends them to the blocks.
    """
    members = cells.groupBy("parent", "cid").agg(F.min("root").alias("root"))
    pairs = cells.groupBy("parent", "region").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("parent").agg(F.sum(F.col("k") * F.col("k")).alias("pairs"))
    every = members.groupBy("parent").agg(F.count(F.lit(1)).cast("double").alias("k"))
    crowded = pairs.join(every, "parent").where(F.col("pairs") > F.col("k") * F.col("k")).select("parent")
    crowded = _bounded(crowded)  # a parent may have many rows
    one = members.join(crowded, "parent", "left_semi").select(F.xxhash64("parent", F.lit("one")).alias("region"), "cid", "root", F.lit(0).cast("bigint").alias("was"))
    return cells.join(crowded, "parent", "left_anti").select("region", "cid", "root", "was").unionByName(one)


def blocks(large: DataFrame) -> DataFrame:
    """Block against block: members in blocks of BLOCK, a region for every two blocks of a region."""
    count = F.ceil(F.col("members") / (BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit("block")), F.col("count")).cast("int")
    dealt = large.withColumn("count", count).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    pair = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))
    return dealt.select(pair.alias("region"), "root", "cid", side.alias("side"))


def join(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    described, logs = describe(documents.select("doc_id", "text"), scratch)
    classes = scratch.table(with_anchors(documents.select("text"), logs, percent), "classes")
    per = described.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first"), F.min("check").alias("low"), F.max("check").alias("high"))
    per = scratch.table(per, "per")
    clash = per.where("low <> high").select("cid")
    if not clash.isEmpty():
        described, classes = (scratch.table(apart(df, clash), name) for df, name in ((described, "described-apart"), (classes, "classes-apart")))
        per = scratch.table(described.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first")), "per-apart")
    anchored = classes.select("cid", F.explode("anchors").alias("anchor"))
    # Classes are told apart before the shuffle, so a frequent anchor costs little; the bitmap lets the few shared ones through.
    leaders = shared_anchors(anchored, scratch)
    shared = bitmaps.holding(anchored, "anchor", scratch.table(bitmaps.pages(leaders, "anchor"), "shared"))
    members = scratch.table(shared.join(leaders, "anchor").select("region", "cid").distinct(), "first-members")
    scratch.drop("leaders", "shared")
    # A class read in several tasks has a row for each.
    profiles = classes.select(F.col("cid").alias("_cid"), F.col("n").alias("_n"), "profile")
    profiles = scratch.table(bitmaps.holding(profiles, "_cid", scratch.table(bitmaps.pages(members, "cid"), "member-ids")).dropDuplicates(["_cid"]), "profiles")
    members = scratch.table(_sized(scratch.table(merge_regions(members, profiles), "merged")), "sized")
    scratch.drop("first-members", "member-ids", "merged")
    described_members = members.where(F.col("members") <= PRUNE).join(profiles, F.col("cid") == F.col("_cid"))
    pruned = prune(described_members.select("region", "cid", F.col("_n").alias("n"), "profile"))
    kept = scratch.table(pruned.unionByName(members.where(F.col("members") > PRUNE).select("region", "cid")), "members")
    scratch.drop("sized", "profiles")
    texts = scratch.table(texts_of(documents.select("text"), classes, kept, scratch), "texts")
    scratch.drop("classes", "classes-apart", "kept-ids", "kept-keys", "keys")
    regions = kept.withColumn("root", F.col("cid")).withColumn("was", F.lit(1 << 62))
    found = join_regions(regions, texts, scratch)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    labels = connected_components(edges, scratch)
    scratch.drop("texts", "members")
    placed = per.select("cid", "first").join(labels, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    best = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(best, "component").select(F.col("cid").alias("_cid"), "component_id")
    out = described.join(named, F.col("cid") == F.col("_cid"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same rows in DuckDB's SQL: all pairs of distinct sets with a common shingle, then all that links reach."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM d),
c AS (SELECT doc_id, s, len(s)::BIGINT AS n, md5(array_to_string(s, chr(10))) AS c FROM s),
x AS (SELECT c, any_value(n) AS n, unnest(any_value(s)) AS g FROM c WHERE n > 0 GROUP BY c),
p AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.g = b.g AND a.c < b.c GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT a AS f, a AS t FROM e UNION SELECT f, b FROM r JOIN e ON t = a),
m AS (SELECT c, min(doc_id) AS first FROM c GROUP BY 1),
k AS (SELECT f AS c, min(first) AS least FROM r JOIN m ON t = c GROUP BY 1)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE coalesce(least, first) END AS component_id FROM c LEFT JOIN k USING (c) LEFT JOIN m USING (c)"""
