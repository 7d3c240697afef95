"""Secret scans by corpus-wide ownership: widely copied examples against owner-specific, live-looking credentials.

Patterns cut each whole text into pieces that end with a match (expressions only), in one pass where there is any; the
pieces' lengths give the positions. Every match's value is a candidate; its hash (MD5) is counted over the corpus by distinct repositories (here: documents) and
owners (here: sources). A value with more than ``max_owners`` owners or more than ``max_repos`` distinct repositories
is an example that people copy, any other belongs to its owner; ``repos`` and ``owners`` are the two counts of each of
the ``spans``, in their order. Fixed kinds (``BASE``) are reported always, with the counts of both sorts in ``n_live`` and
``n_example``; the further kinds (``MORE``) are reported only where the corpus says that they are owner-specific, and
where they overlap no fixed span.

Defined results: a null text is empty; a null id is an id, a null source an owner; equal rows are rows of their own;
no match gives the hash of the empty string; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.scratch import Scratch

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group that holds the value, least length of the value. Order matters in the result.
BASE = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
MORE = (
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{20,}", 0, 25),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("opaque", "(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_.-])", 0, 24),
)
#: A key in use stands in the few repositories of its owner; the number is set by hand, beside MAX_OWNERS.
MAX_OWNERS, MAX_REPOS = 2, 5
#: Places from which on a value's rows stay where they are, and the number of such values that are broadcast (20 MB or so).
HOT, HOT_SENT = 1000, 100_000


def _equals(k: int) -> Callable[[Column], Column]:
    # A function of one argument: a second one would be taken for the element's place.
    return lambda x: x == k


def _varied(value: Column) -> Column:
    """Both cases and at least three digits, with at least 14 different signs: looks drawn at random."""
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9].*[0-9].*[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 14)


def matches(text: Column, kinds: tuple) -> Column:
    """Array of (kind number, pieces) for the kinds that occur; a piece is a match with what stands before it: its length, the match."""

    def last(pattern: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.length(x).alias("size"), F.regexp_extract(x, pattern, 0).alias("hit"))

    found = []
    for k, (_, pattern, _, _) in enumerate(kinds):
        pieces = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
        cut = F.transform(pieces, last(pattern))
        found.append(F.struct(F.lit(k).alias("kind"), F.when(text.rlike(pattern), cut).otherwise(F.array().cast("array<struct<size:int,hit:string>>")).alias("pieces")))
    return F.filter(F.array(*found), lambda x: F.size(x["pieces"]) > 0)


def candidates(rows: DataFrame, kinds: tuple) -> DataFrame:
    """``rid, repo, owner, kind, start, end, value``, one row for each match that is long enough."""
    each = rows.select("rid", "repo", "owner", F.explode("found").alias("f")).select("rid", "repo", "owner", F.col("f.kind").alias("kind"), F.posexplode("f.pieces").alias("i", "x"))
    before = Window.partitionBy("rid", "kind").orderBy("i")
    each = each.withColumn("end", F.sum("x.size").over(before)).withColumn("hit", F.col("x.hit"))
    value, least = F.col("hit"), F.lit(0)
    for k, (_, pattern, group, length) in enumerate(kinds):
        if group:
            value = F.when(F.col("kind") == k, F.regexp_extract("hit", pattern, group)).otherwise(value)
        least = F.when(F.col("kind") == k, F.lit(length)).otherwise(least)
    each = each.select("rid", "repo", "owner", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", value.alias("value"), least.alias("least"))
    opaque = len(kinds) - 1
    return each.where((F.length("value") >= F.col("least")) & ((F.col("kind") != opaque) | _varied(F.col("value")))).drop("least")


def ownership(found: DataFrame) -> DataFrame:
    """``value_hash, repos, owners, places``, the first two distinct; each step sums before it shuffles, so no value's rows meet in one task."""
    repos, owners = (found.select("value_hash", c).distinct().groupBy("value_hash").agg(F.count(F.lit(1)).alias(f"{c}s")) for c in ("repo", "owner"))
    places = found.groupBy(F.col("value_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("places"))
    return repos.join(owners, "value_hash").join(places, F.col("value_hash") == F.col("_hash")).drop("_hash")


def with_owners(found: DataFrame, counted: DataFrame) -> DataFrame:
    """Candidates with the counts of their values. Values of more than ``HOT`` places are few (one in HOT rows at most)
    and are joined by broadcast while they are at most ``HOT_SENT``; so no such value's rows meet in one task."""
    hot = counted.where(F.col("places") > HOT)
    if hot.isEmpty() or hot.count() > HOT_SENT:
        return found.join(counted, "value_hash")
    hot = F.broadcast(hot)
    cold = found.join(hot, "value_hash", "left_anti").join(counted.where(F.col("places") <= HOT), "value_hash")
    return cold.unionByName(found.join(hot, "value_hash"))


def scan(documents: DataFrame, id_col: str = "doc_id", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row a document: counts by fixed kind, digest of the fixed spans, all spans and their ownership, live and example counts."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "secrets")
    kinds = BASE + MORE
    rows = documents.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"),
        matches(F.coalesce(F.col("text"), F.lit("")), kinds).alias("found"),
    )
    rows = scratch.table(rows, "rows")
    found = scratch.table(candidates(rows, kinds).withColumn("value_hash", F.md5(F.col("value").cast("binary"))).drop("value"), "found")
    counted = scratch.table(ownership(found), "owners")
    judged = with_owners(found, counted).withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    judged = judged.where(F.col("live") | (F.col("kind") < len(BASE)))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "repos", "owners")))
    by_row = judged.groupBy("rid").agg(listed.alias("all"))
    base = F.filter("all", lambda x: x["kind"] < len(BASE))
    by_row = by_row.withColumn("base", base).withColumn("all", F.filter("all", lambda x: (x["kind"] < len(BASE)) | ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    out = rows.select("rid", "doc_id").join(by_row, "rid", "left")
    empty = F.array().cast(by_row.schema["all"].dataType)
    out = out.select("doc_id", F.coalesce("base", empty).alias("base"), F.coalesce("all", empty).alias("all"))
    names = F.array(*[F.lit(k[0]) for k in kinds])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.size(F.filter(F.transform("base", lambda x: x["kind"]), _equals(k))).cast("long").alias(f"n_{kind[0]}") for k, kind in enumerate(BASE)]
    live = F.size(F.filter("all", lambda x: x["live"])).cast("long")
    return out.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), F.col("all.repos").alias("repos"), F.col("all.owners").alias("owners"), live.alias("n_live"), (F.size("all") - live).alias("n_example")
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
