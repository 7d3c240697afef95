"""A corpus from documents: quality, near duplicates, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import stages
from tarnfold.llm.scratch import Scratch

STAGES = [
    ("quality classifier", stages.quality_stage),
    ("n-gram Jaccard join", stages.near_duplicate_stage),
    ("benchmark decontamination", stages.decontamination_stage),
    ("mixing sources to target weights", stages.mixing_stage),
    ("sharding", stages.sharding_stage),
]

#: The classifier is trained, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
