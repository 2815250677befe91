"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import stage


def _links(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()


def _mark(links: DataFrame) -> tuple[int, int]:
    got = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1] or 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node with a link.

    Each round writes its links to the shared folder, so lineage stays short and a
    lost executor costs one round's tasks.  Only minima of neighbourhoods are
    gathered, never neighbour lists, so a hub costs one row a task.
    """
    links = stage(_links(links, a, b), "links")
    mark = _mark(links)
    while mark[0]:
        # large star: larger neighbours of u move to the smallest of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select("v", "low")
        links = stage(_links(large, "v", "low"), "links")
        # small star: u and its smaller neighbours move to the smallest of them
        low = links.groupBy("u").agg(F.min("v").alias("low"))
        small = links.join(low, "u").select("v", "low").union(low.select("u", "low"))
        links = stage(_links(small, "v", "low"), "links")
        was, mark = mark, _mark(links)
        if was == mark:
            break
    return links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
