"""What a reader means by a typed name: a file, a folder, or one of several."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import paths as P

#: So many paths are shown that only hold what was typed.  Fixed value.
SIMILAR = 8
_GRAM = 3


def resolve_target(typed: DataFrame, files: DataFrame) -> DataFrame:
    """typed, kind, path: what each typed text (column typed) means among files (column path).

    Tried in order: a path, a folder's path, the one folder that ends so, files that end
    so, files of that name in any case, files that hold it.  kind is file, folder (the
    root's path is empty), which (several files, a row each), similar (the shortest
    ``SIMILAR`` that hold it), or none (path is null).  Texts meet files by keys: ends
    of paths, names, and for the last try groups of three letters.
    """
    asked = typed.select("typed").distinct().withColumn("raw", F.regexp_replace(F.trim(F.coalesce("typed", F.lit(""))), r"^\./", ""))
    files = files.select("path").distinct()
    folders = files.select(F.explode(F.filter(P.ancestors(F.col("path")), lambda d: d != "")).alias("folder")).distinct()
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), -k, k), "/"))
    row = lambda tier, key, path: [F.lit(tier).alias("tier"), key.alias("key"), path.alias("path")]
    path, folder = F.col("path"), F.col("folder")
    keys = (
        files.select(*row(1, path, path)).unionByName(folders.select(*row(2, folder, folder))).unionByName(folders.select(*row(3, F.explode(ends(folder)), folder)))
        .unionByName(files.select(*row(4, F.explode(ends(path)), path))).unionByName(files.select(*row(5, F.lower(P.name_of(path)), path)))
    )
    bare = F.regexp_replace("raw", "/+$", "")
    by = F.when(F.col("tier").isin(2, 3), bare).when(F.col("tier") == 5, F.lower("raw")).otherwise(F.col("raw"))
    tries = asked.where("raw not in ('', '.')").select("typed", "raw", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tier")).withColumn("key", by)
    hits = tries.join(keys, ["tier", "key"]).select("typed", "tier", "path")
    # several folders that end so decide nothing
    counts = hits.groupBy("typed", "tier").agg(F.count(F.lit(1)).alias("n")).where("tier <> 3 or n = 1")
    first = counts.groupBy("typed").agg(F.min(F.struct("tier", "n")).alias("f")).select("typed", "f.tier", "f.n")
    sure = hits.join(first, ["typed", "tier"]).select("typed", F.when(F.col("tier").isin(2, 3), "folder").when(F.col("n") == 1, "file").otherwise("which").alias("kind"), "path")
    left = asked.where("raw not in ('', '.')").join(first, "typed", "left_anti").withColumn("low", F.lower("raw"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(_GRAM)), lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.length("path") - g + 1, F.lit(1))), lambda k: F.lower(F.substring(F.col("path"), k, g))))))
    held = files.select("path", F.explode(grams).alias("gram")).join(left.withColumn("gram", F.left("low", F.lit(_GRAM))), "gram").where(F.contains(F.lower("path"), F.col("low")))
    shortest = Window.partitionBy("typed").orderBy(F.length("path"), "path")
    similar = held.withColumn("k", F.row_number().over(shortest)).where(F.col("k") <= SIMILAR).select("typed", F.lit("similar").alias("kind"), "path")
    none = left.join(similar.select("typed").distinct(), "typed", "left_anti").select("typed", F.lit("none").alias("kind"), F.lit(None).cast("string").alias("path"))
    blank = asked.where("raw in ('', '.')").select("typed", F.when(F.col("raw") == "", "none").otherwise("folder").alias("kind"), F.when(F.col("raw") != "", "").alias("path"))
    return sure.unionByName(similar).unionByName(none).unionByName(blank)
