"""Bitmap filters of bounded size: a set of keys as at most 2 ** (bits - 15) pieces of 4 KB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import unused


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bitmap_of(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """piece, bits: the set of all keys of a table."""
    bit = keys.select(_bit(F.col(key), bits).alias("bit"))
    return bit.groupBy(F.bitmap_bucket_number("bit").alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))


def marked(rows: DataFrame, key: str, bitmap: DataFrame, bits: int, flag: str = "maybe") -> DataFrame:
    """Adds ``flag``: false only for keys that are surely not in the set."""
    rows = rows.withColumn("__bit", _bit(F.col(key), bits))
    at = F.bitmap_bit_position("__bit")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    joined = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number("__bit") == F.col("__piece"), "left")
    maybe = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return joined.withColumn(flag, maybe).drop("__bit", "__piece", "__bits")


def without(rows: DataFrame, key: str, gone: DataFrame, bits: int) -> DataFrame:
    """``rows`` without those whose ``key`` (never null) is in ``gone``; only rows that may be in it are joined."""
    flag = unused(rows, "__maybe")
    seen = marked(rows, key, bitmap_of(gone, key, bits), bits, flag)
    sure = seen.where(~F.col(flag)).drop(flag)
    return sure.unionByName(seen.where(flag).drop(flag).join(gone, key, "left_anti"))
