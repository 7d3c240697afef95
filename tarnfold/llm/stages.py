"""Operators as stages over a table of documents: each takes (spark, docs, sf_dir) and lets its decisions take effect.

All but the last return the columns they were given. Rows are told apart by their place in the table, so null and
repeated ids do no harm; stages read ``docs`` more than once, which is a table. Where one of several rows is chosen, or
rows are put in order, that goes by id and by digests of the whole row, so that reruns over other file splits agree.
Columns that a stage adds for itself have names that ``docs`` has not.

Every stage: a null text is a text without words, a null id an id, a null source a source; equal rows are rows of their
own; an empty table gives an empty table; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm import decontamination, jaccard_join, mixing, quality, sharding


def fresh(docs: DataFrame, name: str) -> str:
    """A name like ``name`` that no column has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    rid = fresh(docs, "_rid")
    return docs.withColumn(rid, F.monotonically_increasing_id()), rid


def _digest(docs: DataFrame):
    """A digest of the whole row, whatever its columns hold."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; texts without words get the score of the bias alone."""
    weights = quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "_score")
    return quality.score(docs, weights, out=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id (ties: of the least digest of its row).

    Texts without words are no copies of each other: all stay.
    """
    rows, rid = _numbered(docs)
    groups = jaccard_join.join(rows.select(F.col(rid).alias("doc_id"), "text")).select(F.col("doc_id").alias("_at"), "component_id")
    named = rows.select(F.col(rid).alias("_row"), F.struct(F.col("doc_id").isNull(), "doc_id", _digest(docs), F.col(rid)).alias("_key"))
    first = groups.join(named, F.col("_at") == F.col("_row")).groupBy("component_id").agg(F.min_by("_row", "_key").alias("_first")).select("_first")
    kept = F.col(rid) == F.col("_first")
    return rows.join(first, kept, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go; without items all stay."""
    leaks = fresh(docs, "_leaks")
    found = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=leaks)
    return found.where(F.size(leaks) == 0).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the proportion that the mix takes them: repeated, once, or left out.

    The part of a document's words that is taken is rounded up or down to whole copies, by a digest of its row and so
    that the expectation stays; texts without words take no part in a mix and go.
    """
    rows, rid = _numbered(docs)
    digest = fresh(docs, "_digest")
    rows = rows.withColumn(digest, _digest(docs))
    taken = mixing.mix(rows.select("doc_id", "source", "text", rid, digest), keep=(rid, digest)).where("taken > 0")
    copies = F.floor(F.try_divide(F.col("taken"), F.col("size")) + mixing.uniform("copy", F.col("doc_id"), F.col(f"_keep_{digest}")))
    taken = taken.select(F.col(f"_keep_{rid}").alias("_taken"), copies.cast("int").alias("_copies")).where("_copies > 0")
    copy = fresh(docs, "_copy")
    made = rows.join(taken, F.col(rid) == F.col("_taken")).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.shard_documents(docs)
