"""Rollups of files by folder and language, and pruned trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import code as C
from sparkloom.functions import paths as P


def with_stats(files: DataFrame) -> DataFrame:
    return files.withColumn("s", C.code_stats(F.col("text"), F.col("lang")))


def languages(files: DataFrame) -> DataFrame:
    """lang, files, loc."""
    return with_stats(files).groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("s.code").cast("long").alias("loc"))


def rollup(files: DataFrame) -> DataFrame:
    """Direct children of every folder: counts, lines by kind, size, languages and share of comments."""
    f = with_stats(files).withColumn("dir", P.dir_of(F.col("path")))
    out = f.groupBy("dir").agg(
        F.count(F.lit(1)).alias("files"), *(F.sum(f"s.{b}").cast("long").alias(a) for a, b in (("loc", "code"), ("comment", "comment"), ("blank", "blank"))),
        F.sum(F.length("text").cast("long")).alias("size"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"),
    )
    return out.withColumn("depth", P.depth_of(F.col("dir")).cast("long")).withColumn("doc_ratio", C.doc_ratio(F.col("comment"), F.col("loc")))


def subtree_counts(files: DataFrame) -> DataFrame:
    """dir, files at or below it; the root is the empty path."""
    return files.select(F.explode(P.ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


def pruned_tree(files: DataFrame, needle: str) -> DataFrame:
    """Files whose path holds the needle, and the folders that lead to them."""
    kept = files.where(F.contains(F.lower("path"), F.lit(needle.lower()))).select("path")
    folders = subtree_counts(kept).select(F.col("dir").alias("node"), F.lit("folder").alias("kind"), "files")
    return folders.unionByName(kept.select(F.col("path").alias("node"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("files")))
