"""Scans. Schemas are declared, never inferred: an inferred schema costs a pass over the data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = str | StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; zone-less timestamps become timestamps (UTC sessions)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def read_json_lines(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_documents(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Whole-file JSON: one document or one array of records a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: Schema, header: bool = True, partitions: int | None = None) -> DataFrame:
    """CSV with a header line in each file; ``partitions`` is the hint of a text scan."""
    df = spark.read.schema(schema).option("header", header).option("enforceSchema", not header).csv(path)
    return df.repartition(partitions) if partitions else df


def read_tsv(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Tab-separated values without a header; carriage returns inside fields stay."""
    return spark.read.schema(schema).option("sep", "\t").option("lineSep", "\n").option("quote", "").csv(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: Schema) -> DataFrame:
    """Record-shaped XML, one row an element ``row_tag``; comments are not data."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_rows(spark: SparkSession, rows: Iterable, schema: Schema) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(list(rows), schema)


def read_database(spark: SparkSession, url: str, dbtable: str, **options: str) -> DataFrame:
    """A JDBC table (needs a driver on the class path), split over a numeric column where bounds are given."""
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """``file, markup``: a directory of markup files of any shape, one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("markup"))
