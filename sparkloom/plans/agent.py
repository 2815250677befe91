"""Payloads for agents: each a JSON text of at most a budget of characters, best parts first.

Parts are ranked; those whose running size stays below the budget are packed, and the
payload says how many were left out.  Ranking and sums are windows of one payload, so
many payloads (a file each) are packed side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph as G

BUDGET = 4_000


def packed(parts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """key, items (texts in order), left_out, size of every payload; parts: key, rank (unique in a key), item (JSON text)."""
    order = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = parts.select("key", "rank", "item", F.sum(F.length("item") + 1).over(order).alias("so_far"))
    fits = F.col("so_far") <= budget
    items = F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("rank", "item")))), lambda x: x["item"])
    return sized.groupBy("key").agg(items.alias("items"), F.count_if(~fits).alias("left_out"), F.coalesce(F.sum(F.when(fits, F.length("item"))), F.lit(0)).cast("long").alias("size"))


def _json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _best(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first ``most`` rows of a list, numbered by ``rank``."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def overview(facts: DataFrame, edges: DataFrame, budget: int = BUDGET, most: int = 50) -> DataFrame:
    """payload, json: sizes, then entry points and hubs as far as the budget goes (of either the first ``most``)."""
    stats = facts.agg(F.count(F.lit(1)).alias("files"), F.count_if((F.col("fan_in") == 0) & ~F.col("is_entry") & ~F.col("is_test")).alias("orphans")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("connections"))))
    entries = _best(facts.where("is_entry"), most, F.desc("fan_out"), "node").select(F.col("rank"), _json(F.lit("entry").alias("kind"), "node", "name", "fan_out").alias("item"))
    hubs = _best(facts.where("fan_in >= 2"), most, F.desc("fan_in"), "node").select((F.col("rank") + most).alias("rank"), _json(F.lit("hub").alias("kind"), "node", "name", "fan_in", "fan_out").alias("item"))
    items = packed(entries.unionByName(hubs).select(F.lit(1).alias("key"), "rank", "item"), budget)
    one = stats.join(F.broadcast(items), how="left")
    json = F.concat(F.lit('{"stats":'), _json("files", "connections", "orphans"), F.lit(',"parts":'), _listed(F.coalesce("items", F.array().cast("array<string>"))), F.lit(',"leftOut":'), F.coalesce("left_out", F.lit(0)).cast("string"), F.lit("}"))
    return one.select(F.lit("overview").alias("payload"), json.alias("json"))


def architecture(layers: DataFrame, folder_edges: DataFrame, budget: int = BUDGET, most: int = 30) -> DataFrame:
    """payload, json: layers with their sizes, then the busiest traffic between folders; layers: node, layer."""
    levels = layers.groupBy("layer").agg(F.count(F.lit(1)).alias("files")).select((F.col("layer") + 1).alias("rank"), _json(F.lit("layer").alias("kind"), F.col("layer").alias("depth"), "files").alias("item"))
    busy = _best(folder_edges, most, F.desc("n"), "src_folder", "dst_folder").select((F.col("rank") + (1 << 20)).alias("rank"), _json(F.lit("traffic").alias("kind"), F.col("src_folder").alias("from"), F.col("dst_folder").alias("to"), F.col("n").alias("count")).alias("item"))
    items = packed(levels.unionByName(busy).select(F.lit(1).alias("key"), "rank", "item"), budget)
    return items.select(F.lit("architecture").alias("payload"), F.concat(F.lit('{"parts":'), _listed(F.col("items")), F.lit(',"leftOut":'), F.col("left_out").cast("string"), F.lit("}")).alias("json"))


def dependencies(bom: DataFrame, budget: int = BUDGET) -> DataFrame:
    """payload, json: an ecosystem a payload, its packages by name; bom: name, label, version, ecosystem, dev, licence."""
    rank = F.row_number().over(Window.partitionBy("ecosystem").orderBy("label", "name"))
    items = packed(bom.select(F.col("ecosystem").alias("key"), rank.alias("rank"), _json(F.col("label").alias("name"), "version", "dev", "licence").alias("item")), budget)
    json = F.concat(F.lit('{"packages":'), _listed(F.col("items")), F.lit(',"leftOut":'), F.col("left_out").cast("string"), F.lit("}"))
    return items.select(F.concat(F.lit("dependencies/"), "key").alias("payload"), json.alias("json"))


def explain_file(facts: DataFrame, edges: DataFrame, budget: int = 300) -> DataFrame:
    """payload, json of every file: its role and degrees, then importers and imports as far as the budget goes."""
    near = G.neighbours(edges, 20)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("side"), "other"))
    items = packed(near.select(F.col("node").alias("key"), rank.alias("rank"), _json("side", "other").alias("item")), budget)
    out = facts.withColumn("role", G.role()).join(items, facts["node"] == items["key"], "left")
    json = F.concat(
        F.lit('{"file":'), _json("node", "name", "role", "fan_in", "fan_out"), F.lit(',"near":'), _listed(F.coalesce("items", F.array().cast("array<string>"))),
        F.lit(',"leftOut":'), F.coalesce("left_out", F.lit(0)).cast("string"), F.lit("}"),
    )
    return out.select(F.concat(F.lit("file/"), F.col("node").cast("string")).alias("payload"), json.alias("json"))


def search(answers: DataFrame, total: DataFrame, budget: int = BUDGET) -> DataFrame:
    """payload, json: answers of a search (path, score, line, snippet), best first, and how many there are in all."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "path"))  # a report of few rows
    items = packed(answers.select(F.lit(1).alias("key"), rank.alias("rank"), _json("path", F.round("score", 2).alias("score"), "line", "snippet").alias("item")), budget)
    one = total.join(F.broadcast(items), how="left")
    json = F.concat(F.lit('{"results":'), _listed(F.coalesce("items", F.array().cast("array<string>"))), F.lit(',"leftOut":'), F.coalesce("left_out", F.lit(0)).cast("string"), F.lit(',"total":'), F.col("total").cast("string"), F.lit("}"))
    return one.select(F.lit("search").alias("payload"), json.alias("json"))
