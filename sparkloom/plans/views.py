"""Scorecards and views: each is a plan over facts, edges and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators.findings import grade
from sparkloom.storage import stage


def resolve(imports: DataFrame, spec: Column, files: DataFrame, endings: tuple[str, ...], root: str = "lib/") -> DataFrame:
    """The imports with path: the first candidate (spec with an ending) that is a file, or null."""
    # a file tells which texts ask for it, so imports are only met once, by their text
    told = F.array_compact(F.array(*(F.when(F.startswith("path", F.lit(root)) & F.endswith("path", F.lit(e)) & (F.length("path") >= len(root) + len(e)), F.struct(
        F.substring("path", F.lit(len(root) + 1), F.length("path") - len(root) - len(e)).alias("asked"), F.lit(k).alias("k"))) for k, e in enumerate(endings))))
    found = files.select("path", F.explode(told).alias("t")).groupBy("t.asked").agg(F.min(F.struct("t.k", "path"))["path"].alias("path"))
    return imports.join(found, spec == found["asked"], "left").select(*imports.columns, "path")


def tested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that tests reach through nodes that are no tests."""
    flags = nodes.select("node", "is_test")
    inner = edges.join(flags.select(F.col("node").alias("dst"), F.col("is_test").alias("t")), "dst").where("not t").select("src", "dst")
    inner = stage(inner, "tested-edges")
    start = nodes.where("is_test").select(F.col("node").alias("src")).join(inner, "src").select(F.lit(1).alias("key"), F.col("dst").alias("node"))
    return G.reach(start, inner).select("node")


def _foldered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select(F.col("node").alias("src"), F.col("folder").alias("src_folder"))
    b = nodes.select(F.col("node").alias("dst"), F.col("folder").alias("dst_folder"))
    return edges.join(a, "src").join(b, "dst")


def folder_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _foldered(nodes, edges).where("src_folder <> dst_folder").groupBy("src_folder", "dst_folder").agg(F.count(F.lit(1)).alias("n"))


def coupling(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Traffic between the folders with the most of it, and its maximum."""
    between = stage(folder_edges(nodes, edges), "coupling")
    ends = between.select(F.col("src_folder").alias("folder"), "n").union(between.select("dst_folder", "n"))
    top = ends.groupBy("folder").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "folder").limit(most).select("folder")
    shown = between.join(top.withColumnRenamed("folder", "src_folder"), "src_folder", "left_semi").join(top.withColumnRenamed("folder", "dst_folder"), "dst_folder", "left_semi")
    return shown.withColumn("most", F.max("n").over(Window.partitionBy(F.lit(1))))  # at most ``most`` squared rows


def folder_traffic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = _foldered(nodes, edges)
    same = F.col("src_folder") == F.col("dst_folder")
    out = e.select(F.col("src_folder").alias("folder"), same.alias("i"), (~same).alias("o"), F.lit(False).alias("w"))
    into = e.where(~same).select(F.col("dst_folder").alias("folder"), F.lit(False).alias("i"), F.lit(False).alias("o"), F.lit(True).alias("w"))
    return out.unionByName(into).groupBy("folder").agg(F.count_if("i").alias("internal"), F.count_if("o").alias("outward"), F.count_if("w").alias("inward"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Risk of every node."""
    edges = stage(edges, "health-edges")
    comp = stage(G.components(nodes, edges), "health-components")
    many = comp.groupBy("component").count().where("count > 1").select("component")
    return G.health(G.degrees(nodes, edges), G.pagerank(nodes, edges), comp.join(many, "component", "left_semi"))


def score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The repository's score with what is taken off for cycles, risky files, complexity and orphans."""
    edges = stage(edges, "score-edges")
    per_file = stage(health(nodes, edges), "score-files")
    t = per_file.agg(F.count_if(F.expr("risk >= 70")).alias("crit"), F.count_if(F.expr("risk >= 50 and risk < 70")).alias("high"), F.avg("complexity").alias("cx"), F.count(F.lit(1)).alias("n"))
    cycles = G.cycles(nodes, edges).agg(F.least(F.lit(10), F.count(F.lit(1))).alias("cycles"))
    alone = G.orphans(G.degrees(nodes, edges)).agg(F.count(F.lit(1)).alias("orphans"))
    points = lambda x: F.floor(x + 0.5).cast("long")
    out = t.crossJoin(cycles).crossJoin(alone).withColumns({
        "d_cycles": points(F.col("cycles") * 4), "d_risk": points(F.col("crit") * 4 + F.col("high") * 2),
        "d_cx": points(F.greatest(F.lit(0.0), F.col("cx") - 6) * 2), "d_orphans": points(25.0 * F.col("orphans") / F.greatest("n", F.lit(1))),
    })
    out = out.withColumn("score", F.greatest(F.lit(0).cast("long"), 100 - F.col("d_cycles") - F.col("d_risk") - F.col("d_cx") - F.col("d_orphans")))
    return out.withColumn("grade", grade(F.col("score"), (90, 80, 70, 60))).drop("cx", "n")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def orphan() -> Column:
    return (F.col("fan_in") == 0) & ~F.col("is_entry") & ~F.col("is_test")


def patterns(facts: DataFrame) -> DataFrame:
    """pattern, n, example of every pattern that occurs; one pass over the facts."""
    tests = {
        "hub-and-spoke": F.col("fan_in") >= 5, "god-files": F.col("fan_in") + F.col("fan_out") >= 12,
        "barrels": (F.col("fan_in") >= 2) & (F.col("fan_out") >= 2) & (F.col("complexity") <= 5), "test-shadow": F.col("is_test"), "orphans": orphan(), "entries": F.col("is_entry"),
    }
    found = F.explode(F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items()))))
    return facts.select("node", found.alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("example"))


#: Thresholds of further patterns: layers of a shape, users of an anchor; layers are looked for so deep.  Fixed values.
SHAPE, ANCHOR, DEPTH = 3, 3, 12


def further_patterns(
    facts: DataFrame, edges: DataFrame, cycles: DataFrame, untested_hubs: DataFrame, dead_exports: DataFrame, drift: DataFrame, externals: DataFrame, services: DataFrame
) -> DataFrame:
    """pattern, severity, n, example of what other reports found; one row a pattern that occurs.

    cycles: component, size; untested_hubs: node; dead_exports: path, name; drift: name,
    drift; externals: name, users; services: name.  Layers are distances from entries.
    """
    told = lambda df, pattern, severity, n, example: df.agg(n.cast("long").alias("n"), example.cast("string").alias("example")).select(F.lit(pattern).alias("pattern"), F.lit(severity).alias("severity"), "n", "example")
    every = F.count(F.lit(1))
    depth = stage(G.reach(facts.where("is_entry").select(F.lit(1).alias("key"), "node"), edges, DEPTH), "pattern-depths")
    layers = depth.agg((F.coalesce(F.max("depth"), F.lit(-1)) + 1).alias("layers"))
    shaped = layers.where(F.col("layers") >= SHAPE)
    off = facts.join(depth.select("node"), "node", "left_anti").join(F.broadcast(shaped)).select("node")
    heaviest = externals.where(F.col("users") >= ANCHOR).orderBy(F.desc("users"), "name").limit(1)
    tests = facts.agg(F.count_if("is_test").alias("n")).where("n = 0")
    parts = [
        told(shaped, "layered-shape", "info", F.max("layers"), F.lit("")), told(off, "unreachable", "info", every, F.min("node")),
        told(cycles, "cycles", "high", every, F.max_by("component", F.struct("size", (-F.col("component")).alias("low")))), told(untested_hubs, "untested-hubs", "high", every, F.min("node")),
        told(dead_exports, "dead-exports", "low", every, F.min("path")), told(drift.where("drift = 'undeclared'"), "undeclared-deps", "high", every, F.min("name")),
        told(drift.where("drift = 'unused'"), "unused-deps", "low", every, F.min("name")), told(heaviest, "top-external", "info", F.max("users"), F.max("name")),
        told(services, "services", "info", every, F.min("name")), told(tests, "no-tests", "medium", every, F.lit("")),
    ]
    return _union(parts).where("n > 0")


def tour(facts: DataFrame, cycles: DataFrame) -> DataFrame:
    """node, slot of a reading order; a node keeps its first slot.

    1: the entry that imports most, 2 to 4: hubs, 5: a second entry, 6: a leaf, 7: the
    first member of the largest cycle (cycles: component, size), 8: an orphan.
    """

    def pick(df: DataFrame, slots: tuple[int, ...], *order: Column | str) -> DataFrame:
        first = df.orderBy(*order).limit(len(slots)).select("node", F.row_number().over(Window.orderBy(*order)).alias("k"))
        return first.select("node", F.get(F.array(*map(F.lit, slots)), F.col("k") - 1).alias("slot"))

    stops = [
        pick(facts.where("is_entry"), (1, 5), F.desc("fan_out"), "node"), pick(facts.where("fan_in >= 2"), (2, 3, 4), F.desc("fan_in"), "node"),
        pick(facts.where("fan_out = 0 and fan_in >= 2"), (6,), F.desc("fan_in"), "node"), pick(cycles.withColumnRenamed("component", "node"), (7,), F.desc("size"), "node"),
        pick(facts.where(orphan()), (8,), "node"),
    ]
    return _union(stops).groupBy("node").agg(F.min("slot").alias("slot"))


def inspector(facts: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """One row a node with its first importers and imports."""
    near = G.neighbours(edges, most).groupBy("node").pivot("side", ["importer", "import"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list("other")), lambda x: x.cast("string")), ","))
    out = facts.join(near, "node", "left")
    return out.select("node", "complexity", "loc", "fan_in", "fan_out", F.coalesce("importer", F.lit("")).alias("importers"), F.coalesce("import", F.lit("")).alias("imports"))


def report(facts: DataFrame) -> DataFrame:
    """A JSON line a node, for a stable snapshot."""
    return facts.select("node", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "node", "name", "fan_in", "fan_out", G.role().alias("role"))).alias("json"))


def diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A line of diagram text for every pair of folders with traffic, busiest first."""
    e = folder_edges(nodes, edges)
    return e.select("n", F.concat(F.lit("  "), F.translate("src_folder", "# ", "__"), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), F.translate("dst_folder", "# ", "__")).alias("line")).orderBy(F.desc("n"), "line")


def atlas(facts: DataFrame, most: int = 200) -> DataFrame:
    """kind, title, n: a card a folder and for the most imported files."""
    folders = facts.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).select(F.lit("folder").alias("kind"), F.col("folder").alias("title"), "n")
    top = facts.orderBy(F.desc("fan_in"), "node").limit(most).select(F.lit("file").alias("kind"), F.col("node").cast("string").alias("title"), F.col("fan_in").alias("n"))
    return folders.unionByName(top)


def risks(facts: DataFrame) -> DataFrame:
    """risk, n of what is worth a look."""
    counts = facts.agg(F.count_if(orphan()).alias("orphans"), F.count_if(F.expr("complexity >= 28")).alias("complex"), F.count_if(F.expr("loc >= 900")).alias("large"), F.count_if(F.expr("fan_in >= 5")).alias("hubs"))
    return counts.select(F.expr("stack(4, 'orphans', orphans, 'complex', complex, 'large', large, 'hubs', hubs) as (risk, n)")).where("n > 0")
