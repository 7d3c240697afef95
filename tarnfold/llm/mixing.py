"""Mixing sources to target weights: fixed-length blocks, multinomial source counts per output shard, permuted indices.

Words of a source form one stream (rows in the order of a digest of id and size), packed into blocks of ``BLOCK``
words. The mix is a row of slots for blocks, ``SHARD_BLOCKS`` to an output shard; every source has as many slots as its
target asks for. Which slots these are is drawn: a keyed permutation of all slots deals them out, so the source counts of
an output shard are a multinomial draw, given that all shards together meet the targets (a draw without that condition
misses a target of n blocks by about the root of n). Slot j of a source reads block ``p(j mod blocks)`` of pass
``j div blocks``, where p is a pseudorandom permutation of the source's block indices, keyed by source and pass. Slots
and blocks then join by index. All keys are MD5 digests of fixed texts, so reruns agree.

Permutations of any size n: x = l + a r with l < a, r < b, a b >= n hardly larger; four rounds add a keyed number made
from the one part to the other (l, r, l, r); results beyond n go through the rounds again until they are within.

Targets: sources by code point, null last, weigh 1, 2, 3, 1, ...; they share all words by weight; none goes above
``MAX_REPEAT`` times its size, the excess is shared again by weight. Slots beyond ``MAX_REPEAT`` passes don't exist, so
no document is taken more often than that.

Defined results: null and empty texts have size 0 and take 0; a null source is a source; equal rows are rows of their
own; rows alike in id and size stand in the order of a digest of the text; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.scratch import Scratch
from tarnfold.llm.slots import BUCKET_ROWS, hex_bucket, running_totals

BLOCK = 64
SHARD_BLOCKS = 1024
MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
#: Slots that a row becomes at once.
_CHUNK = 4096
_PRIME, _FACTOR = 2147483647, 40503
#: Times through the rounds at most; a turn leaves at most a quarter outside, so none is left after these.
_TURNS = 48


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 digest of the parts."""
    text = F.concat_ws(":", *[(F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def round_keys(*parts: Column | str) -> Column:
    """Four keys below 2**28 from the MD5 digest of the parts."""
    text = F.concat_ws(":", *[(F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts])
    digest = F.md5(text.cast("binary"))
    return F.array(*[F.conv(F.substring(digest, 1 + 7 * k, 7), 16, 10).cast("long") for k in range(4)])


def permuted(x: Column, size: Column, keys: Column) -> Column:
    """The place of x in the keyed permutation of 0 to ``size`` - 1."""
    a = F.ceil(F.sqrt(size.cast("double")))
    b = F.ceil(size / a)
    prime = F.lit(_PRIME)

    def mixed(v: Column, k: int) -> Column:
        return ((v % prime) * (v % prime) % prime * _FACTOR + keys[k]) % prime

    def rounds(v: Column) -> Column:
        left, right = v % a, F.floor((v - v % a) / a)
        left = (left + mixed(right, 0)) % a
        right = (right + mixed(left, 1)) % b
        left = (left + mixed(right, 2)) % a
        right = (right + mixed(left, 3)) % b
        return left + a * right

    once = rounds(x)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(_TURNS)), once, lambda v, _: F.when(v < size, v).otherwise(rounds(v)))
    return F.when(once < size, once).otherwise(again)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, rank, source_size, target`` and the number of all words, one row a source.

    One row a source meets in one task here: the table of sources, not of documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    per = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("total", F.sum("source_size").over(everything))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_repeat)
    # Sources fill up in the order of cap / weight; level is what a weight of 1 gets once all earlier ones are full.
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("final", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    return per.select("source", "rank", "source_size", "total", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def slots(sources: DataFrame, scratch: Scratch, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``shard, place, rank, block``: the block of a source that each slot of each output shard reads.

    A source's slots of one pass are cut into rows of ``_CHUNK``, dealt out before they become slots.
    """
    blocks = F.ceil(F.col("source_size") / block)
    wanted = F.least(F.floor(F.col("target") / block + 0.5).cast("long"), blocks * max_repeat)
    s = sources.where("source_size > 0").select("rank", blocks.alias("blocks"), wanted.alias("n"))
    ordered, everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    s = s.withColumn("low", F.coalesce(F.sum("n").over(ordered), F.lit(0))).withColumn("all", F.sum("n").over(everything))
    s = s.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))).withColumn("first", F.col("turn") * F.col("blocks")).where("first < n")
    s = s.withColumn("last", F.least(F.col("n"), F.col("first") + F.col("blocks"))).withColumn("keys", round_keys("block", F.col("rank"), F.col("turn"))).withColumn("deal", round_keys("slot"))
    s = scratch.table(s, "turns")  # a row a source and pass
    s = s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first") - 1) / _CHUNK))))
    s = s.repartition("rank", "turn", "chunk")
    start = F.col("first") + F.col("chunk") * _CHUNK
    s = s.withColumn("j", F.explode(F.sequence(start, F.least(F.col("last"), start + _CHUNK) - 1)))
    slot = permuted(F.col("low") + F.col("j"), F.col("all"), F.col("deal"))
    index = permuted(F.col("j") - F.col("first"), F.col("blocks"), F.col("keys"))
    return s.select(F.floor(slot / shard_blocks).alias("shard"), (slot % shard_blocks).cast("int").alias("place"), "rank", index.cast("long").alias("block"))


def draws(made: DataFrame) -> DataFrame:
    """``shard, rank, n``: how many blocks of each source every output shard got."""
    return made.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))


def block_counts(made: DataFrame) -> DataFrame:
    """``rank, block, times``: how often the mix reads each block."""
    return made.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))


def mix(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row; ``keep`` names columns of ``documents`` to carry along."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    extra = [F.col(c).alias(f"_keep_{c}") for c in keep]
    rows = documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_t"), *extra)
    rows = rows.withColumn("_h", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string")).cast("binary")))
    rows = scratch.table(rows, "rows")
    sources = scratch.table(targets(rows), "sources")
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    placed = running_totals(rows.withColumn("_bucket", hex_bucket(F.col("_h"), buckets)), ["source"], "_bucket", ["_h", "doc_id", "_t"], F.col("size"))
    named = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    kept = [f"_keep_{c}" for c in keep]
    placed = placed.join(named, placed["source"].eqNullSafe(named["_source"])).select("rank", "doc_id", "before", "size", "source_size", "target", *kept)
    # Spark takes the rows that explode makes for few: without the hint it would broadcast a row for every block.
    times = block_counts(slots(sources, scratch)).hint("merge")
    first, last = F.expr(f"before div {BLOCK}"), F.expr(f"(before + size - 1) div {BLOCK}")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    words = F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("before"), F.col("block") * BLOCK)
    keys = ["rank", "doc_id", "before", "size", "source_size", "target", *kept]
    taken = pieces.withColumn("words", words).join(times, ["rank", "block"], "left").groupBy(*keys).agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken", *kept]
    return taken.select(*out).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    m = _PRIME

    def mixed(v: str, k: int) -> str:
        return f"((({v}) % {m}) * (({v}) % {m}) % {m} * {_FACTOR} + ('0x' || substr(digest, {1 + 7 * k}, 7))::BIGINT) % {m}"

    def rounds(v: str) -> str:
        left, right = f"(({v}) % a)", f"(({v}) // a)"
        left = f"(({left} + {mixed(right, 0)}) % a)"
        right = f"(({right} + {mixed(left, 1)}) % b)"
        left = f"(({left} + {mixed(right, 2)}) % a)"
        right = f"(({right} + {mixed(left, 3)}) % b)"
        return f"({left} + a * {right})"

    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank, (sum(source_size) OVER ())::BIGINT AS total FROM s1),
s3 AS (SELECT *, {list(WEIGHTS)}[(rank % {len(WEIGHTS)} + 1)::INTEGER] AS weight, source_size * {MAX_REPEAT} AS cap FROM s2),
s4 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
s5 AS (SELECT *, (SELECT level FROM s4 o WHERE o.level * o.weight <= o.cap ORDER BY o.cap / o.weight, o.rank LIMIT 1) AS final FROM s4),
sources AS (SELECT source, rank, source_size, total, least(cap::DOUBLE, coalesce(final * weight, cap)) AS target FROM s5),
e1 AS (SELECT rank, target, ceil(source_size / {BLOCK})::BIGINT AS blocks FROM sources WHERE source_size > 0),
e2 AS (SELECT *, least(floor(target / {BLOCK} + 0.5)::BIGINT, blocks * {MAX_REPEAT}) AS n, ceil(sqrt(blocks::DOUBLE))::BIGINT AS a FROM e1),
e3 AS (SELECT *, ceil(blocks / a)::BIGINT AS b, unnest(range({MAX_REPEAT})) AS turn FROM e2),
e4 AS (SELECT *, md5(concat_ws(':', 'block', rank, turn)) AS digest, unnest(range(turn * blocks, least(n, (turn + 1) * blocks))) - turn * blocks AS x FROM e3 WHERE turn * blocks < n),
walk AS (SELECT rank, blocks, a, b, digest, {rounds("x")} AS y FROM e4 UNION ALL SELECT rank, blocks, a, b, digest, {rounds("y")} FROM walk WHERE y >= blocks),
times AS (SELECT rank, y AS block, count(*) AS times FROM walk WHERE y < blocks GROUP BY ALL),
placed AS (SELECT rank, doc_id, size, source_size, target, (sum(size) OVER (PARTITION BY rank ORDER BY md5(concat_ws(':', doc_id, size)), doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM d JOIN sources ON d.source IS NOT DISTINCT FROM sources.source),
pieces AS (SELECT *, unnest(range(before // {BLOCK}, (before + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0)
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target, sum((least(before + size, (block + 1) * {BLOCK}) - greatest(before, block * {BLOCK})) * coalesce(times, 0))::BIGINT AS taken
FROM pieces LEFT JOIN times USING (rank, block) GROUP BY rank, doc_id, before, size
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM placed WHERE size = 0"""
