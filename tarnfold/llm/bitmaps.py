"""Bitmaps of keys: a bounded filter that lets all wanted rows through, and few others, before a join moves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**26 bits are 8 MB, whatever the input. Far more keys than bits fill it; then it lets all rows through, which the join mends.
BITS = 26
_PAGE = 15  # bits of a page, as the bitmap functions have them


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return F.shiftright(at, _PAGE), at.bitwiseAND((1 << _PAGE) - 1)


def pages(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``_page, _bits``: at most ``2**(bits - 15)`` rows of 4 KB each."""
    page, place = _place(F.col(key), bits)
    return keys.select(page.alias("_page"), place.alias("_place")).groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits"))


def _joined(df: DataFrame, key: str, made: DataFrame, bits: int, how: str) -> tuple[DataFrame, Column]:
    page, place = _place(F.col(key), bits)
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(F.col("_place"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, F.col("_place").bitwiseAND(7).cast("int")) == 1
    return df.withColumn("_at", page).withColumn("_place", place).join(F.broadcast(made), F.col("_at") == F.col("_page"), how), there  # 2**(bits - 3) bytes at most


def holding(df: DataFrame, key: str, made: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose key has its bit set in the written ``pages``."""
    joined, there = _joined(df, key, made, bits, "inner")
    return joined.where(there).select(*df.columns)


def missing(df: DataFrame, key: str, made: DataFrame, bits: int = BITS) -> DataFrame:
    """The other rows."""
    joined, there = _joined(df, key, made, bits, "left")
    return joined.where(~F.coalesce(there, F.lit(False))).select(*df.columns)
