"""Relational operators beyond one method call."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.sources import Workspace

#: Pairs that a task counts at once, and pairs of values up to which each has a counter of its own.
PAIR_CELLS = 1 << 22
#: Rows from which a task makes pairs, at least one group of them.
PAIR_ROWS = 1 << 20


def anti_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of ``left`` without a match; null keys never match, so they stay."""
    return left.join(right, on, "left_anti")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; rows beyond k are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).withColumnRenamed("_rank", "rank")


def ties_at_max(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """All rows that share a key's greatest value."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_rank = 1").drop("_rank")


def null_profile(df: DataFrame) -> DataFrame:
    """``column_name, nulls, total``, in one pass over the table."""
    counts = df.select(F.count(F.lit(1)).alias("_total"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])
    return counts.select(F.explode(pairs).alias("p"), "_total").select("p.column_name", F.coalesce("p.nulls", F.lit(0)).alias("nulls"), F.col("_total").alias("total"))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, is_constant``: least value equals greatest, in one pass."""
    made = df.select(*[(F.min(c) == F.max(c)).alias(c) for c in columns])
    return made.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("is_constant")) for c in columns])).alias("p")).select("p.*")


def _group_pairs(group: np.ndarray, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``a, b, common`` of whole groups: all pairs inside each, counted. Rows ``group, at`` (places in ``ids``) are distinct and sorted."""
    n, size = len(ids), np.bincount(group)
    first = np.cumsum(size) - size
    dense = np.zeros(n * n, dtype=np.int64) if n * n <= PAIR_CELLS else None
    for k in np.unique(size[size > 1]):
        alike, step = first[size == k], max(1, 2 * PAIR_CELLS // (k * (k - 1)))
        for start in range(0, len(alike), step):
            rows, held, cells = at[alike[start : start + step, None] + np.arange(k)], [], 0
            for i in range(k - 1):
                held.append((rows[:, i : i + 1] * n + rows[:, i + 1 :]).ravel())
                cells += held[-1].size
                if cells < PAIR_CELLS and i < k - 2:
                    continue
                if dense is not None:
                    dense += np.bincount(np.concatenate(held), minlength=n * n)
                else:
                    codes, counts = np.unique(np.concatenate(held), return_counts=True)
                    yield ids[codes // n], ids[codes % n], counts
                held, cells = [], 0
    if dense is not None:
        codes = np.flatnonzero(dense)
        yield ids[codes // n], ids[codes % n], dense[codes]


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, common``: counts of pairs over a million rows ``shared, a`` at a time, which come sorted by ``shared``; a pair may come again."""
    held, rows, kind = [], 0, None
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows, kind = rows + batch.num_rows, batch.column(1).type
            if rows < PAIR_ROWS:
                continue
        if not rows:
            return
        table = pa.Table.from_batches(held)
        shared, a = (table.column(k).to_numpy() for k in (0, 1))
        ids, at = np.unique(a, return_inverse=True)
        starts = np.concatenate([[0], np.flatnonzero(shared[1:] != shared[:-1]) + 1])
        codes = np.sort(np.repeat(np.arange(len(starts)), np.diff([*starts, rows])) * len(ids) + at)
        group, at = np.divmod(codes[np.diff(codes, prepend=-1) > 0], len(ids))
        whole = group < len(starts) - (batch is not None)  # the last group may go on
        for left, right, counts in _group_pairs(group[whole], ids, at[whole]):
            for k in range(0, len(left), 1 << 18):
                yield pa.record_batch([pa.array(left[k : k + (1 << 18)], kind), pa.array(right[k : k + (1 << 18)], kind), pa.array(counts[k : k + (1 << 18)])], ["a", "b", "common"])
        rest = ids[at[~whole]]
        held = [pa.record_batch([pa.array(np.repeat(shared[-1:], len(rest)), table.schema.types[0]), pa.array(rest, kind)], table.schema.names)]
        rows = len(rest)


def pair_overlap(df: DataFrame, left: str, shared: str, least: int) -> DataFrame:
    """``a, b, common``: pairs of ``left`` values with at least ``least`` common ``shared`` values.

    Pairs are made inside each shared value, never by a nested loop over all. Shared values lie by range, so where those
    near each other have the same ``left`` values a task sums most counts before the shuffle.
    """
    rows = df.select(F.col(shared).alias("shared"), F.col(left).alias("a")).dropna()
    kind = df.schema[left].dataType.simpleString()
    each = rows.repartitionByRange("shared").sortWithinPartitions("shared").mapInArrow(_pair_counts, f"a {kind}, b {kind}, common bigint")
    return each.groupBy("a", "b").agg(F.sum("common").alias("common")).where(F.col("common") >= least)


def one_hot(df: DataFrame, column: str, values: list, drop_first: bool = True) -> DataFrame:
    """0/1 columns for the sorted values, the first left out."""
    kept = sorted(values)[1 if drop_first else 0 :]
    return df.select("*", *[(F.col(column) == v).cast("int").alias(f"{column}_{v}".replace("-", "_").replace(" ", "_")) for v in kept])


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "variable", "value")


def with_index(df: DataFrame, order: list[Column], work: Workspace, name: str = "numbered", out: str = "_index") -> DataFrame:
    """Rows numbered from 0 in a total order: range partitions are sorted beside each other, their sizes give the offsets."""
    placed = work.table(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.max(row).alias("_last"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), part == F.col("_part")).withColumn(out, F.col("_start") + row).drop("_at", "_part", "_start")


def align_rows(left: DataFrame, left_order: list[Column], right: DataFrame, right_order: list[Column], work: Workspace) -> DataFrame:
    """Row k of one frame beside row k of the other; rows without a partner go."""
    a = with_index(left, left_order, work, "left")
    b = with_index(right, right_order, work, "right", "_other")
    return a.join(b, F.col("_index") == F.col("_other")).drop("_other").withColumnRenamed("_index", "position")


def transpose(df: DataFrame, row: str, values: list[str], columns: list) -> DataFrame:
    """``variable`` and a column for each of the given ``row`` values: what stood in row r, column v stands in row v, column r."""
    long = df.unpivot([row], values, "variable", "value")
    return long.groupBy("variable").pivot(row, columns).agg(F.first("value"))
