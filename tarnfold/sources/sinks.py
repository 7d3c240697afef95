"""Sinks: every writer is distributed, one file or more a partition."""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> str:
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)
    return path


def write_report(df: DataFrame, line: Column, path: str) -> str:
    """Hand-formatted text, one line a row."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str = "rows") -> str:
    df.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)
    return path


def write_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """A table of the catalog by name, its files in ``path``; returned as read by that name."""
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_json_document(df: DataFrame, path: str) -> str:
    """One JSON document that holds all rows as an array; for tables that fit a row."""
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_chart(df: DataFrame, path: str, mark: str, x: str, y: str, most: int = 10_000) -> str:
    """A chart of aggregated rows as a Vega-Lite document; more than ``most`` points are an error, not a sample."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} points; aggregate to {most} at most")
    spec = F.to_json(F.struct(
        F.lit("https://vega.github.io/schema/vega-lite/v5.json").alias("$schema"), F.lit(mark).alias("mark"),
        F.struct(F.struct(F.lit(x).alias("field")).alias("x"), F.struct(F.lit(y).alias("field")).alias("y")).alias("encoding"),
        F.struct(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("values")).alias("data"),
    ))
    df.agg(spec.alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def put_documents(df: DataFrame, url: str, key: str, timeout: float = 10.0) -> int:
    """PUTs each row as JSON to ``url/key``; rows go out from the executors, the number of accepted ones comes back."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("body"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = 0
        for pdf in batches:
            for k, body in zip(pdf["key"], pdf["body"], strict=True):
                request = urllib.request.Request(f"{url.rstrip('/')}/{urllib.parse.quote(k, safe='')}.json", body.encode(), {"Content-Type": "application/json"}, method="PUT")
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    done += reply.status < 300
        yield pd.DataFrame({"n": [done]})

    return rows.mapInPandas(send, "n bigint").agg(F.sum("n")).first()[0] or 0
