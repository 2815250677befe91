"""Diagram texts (Mermaid) out of ordered rows: calls of a file, services, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.code import mermaid_text, short_name

#: Nodes of a layer and links that are drawn.  Fixed values.
IN_LAYER, LINKS = 10, 70


def _joined(head: str, *parts: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit(head)), *parts), "\n")


def calls(found: DataFrame) -> DataFrame:
    """path, text: functions of a file in order of their names, and who calls whom; found: path, caller, callee."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("caller", "callee")))))
    out = found.groupBy("path").agg(names.alias("names"), F.array_sort(F.collect_set(F.struct("caller", "callee"))).alias("pairs"))
    number = lambda n: F.concat(F.lit("n"), (F.array_position("names", n) - 1).cast("string"))
    nodes = F.transform("names", lambda n: F.concat(F.lit("  "), number(n), F.lit('["'), mermaid_text(n), F.lit('()"]')))
    links = F.transform("pairs", lambda p: F.concat(F.lit("  "), number(p["caller"]), F.lit(" --> "), number(p["callee"])))
    return out.select("path", _joined("flowchart LR", nodes, links).alias("text"))


def services(found: DataFrame, linked: DataFrame) -> DataFrame:
    """file, text: services with image and ports, and the folders that they are built from; linked: file, name, folder."""
    s = found.join(linked.select("file", "name", "folder"), ["file", "name"], "left")
    label = F.concat_ws("\\n", mermaid_text(F.col("name")), mermaid_text(F.col("image")), F.when(F.size("ports") > 0, F.array_join("ports", ", ")))
    row = F.struct("at", label.alias("label"), "folder")
    out = s.groupBy("file").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    node = lambda i: F.concat(F.lit("  svc"), i.cast("string"))
    nodes = F.transform("rows", lambda r, i: F.concat(node(i), F.lit('(["'), r["label"], F.lit('"])')))
    links = F.filter(F.transform("rows", lambda r, i: F.concat(node(i), F.lit(" -.-> dir"), i.cast("string"), F.lit('["'), F.when(r["folder"] == "", "(root)").otherwise(mermaid_text(r["folder"])), F.lit('"]'))), lambda x: x.isNotNull())
    return out.select("file", _joined("flowchart LR", nodes, links).alias("text"))


def layers(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One text: a box a layer with its first ``IN_LAYER`` nodes, and the first ``LINKS`` links between nodes that are shown.

    found: node, layer, label.  Shown nodes are at most ten a layer, so the text grows with the depth alone.
    """
    rank = F.row_number().over(Window.partitionBy("layer").orderBy("node"))
    shown = found.withColumn("k", rank).where(F.col("k") <= IN_LAYER)
    sizes = found.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    one = shown.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "label"))), lambda r: F.concat(F.lit("    n"), r["node"].cast("string"), F.lit('["'), mermaid_text(short_name(r["label"])), F.lit('"]'))).alias("nodes"))
    more = F.when(F.col("n") > IN_LAYER, F.array(F.concat(F.lit("    more"), F.col("layer").cast("string"), F.lit('["+ '), (F.col("n") - IN_LAYER).cast("string"), F.lit(' more"]')))).otherwise(F.array().cast("array<string>"))
    box = F.concat(F.array(F.concat(F.lit("  subgraph L"), F.col("layer").cast("string"))), "nodes", more, F.array(F.lit("  end")))
    boxes = one.join(sizes, "layer").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("layer", box.alias("lines")))), lambda r: r["lines"])).alias("boxes"))
    on = shown.select("node")
    drawn = edges.join(on.withColumnRenamed("node", "src"), "src", "left_semi").join(on.withColumnRenamed("node", "dst"), "dst", "left_semi").orderBy("src", "dst").limit(LINKS)
    links = drawn.agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst"))), lambda r: F.concat(F.lit("  n"), r["src"].cast("string"), F.lit(" --> n"), r["dst"].cast("string"))).alias("links"))
    return boxes.join(F.broadcast(links)).select(_joined("flowchart TD", F.col("boxes"), F.col("links")).alias("text"))
