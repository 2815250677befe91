"""Views of one file, of history and of a first contribution, and fact sheets, as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.storage import spread, stage

#: Names of ways in, guides, and manifests.  Fixed values.
ENTRY = r"(?i)(^|/)(index|main|app|server|cli|manage|cmd)(\.|/)"
GUIDE = r"(?i)(^|/)(readme|contributing|architecture|getting-started)(\.|$)"
MANIFEST = r"(?i)(^|/)(package\.json|pyproject\.toml|requirements\.txt|go\.mod|cargo\.toml|dockerfile|\.env\.example)$"
TEST = r"(?i)(^|/)(__tests__|tests?|spec)(/|$)|[._-](test|spec)\."
SOURCE = r"(?i)\.(js|jsx|mjs|cjs|ts|tsx|py|go|rs|java)$"
#: Most entries and pairs of folders in a sheet.
TRAFFIC = 20
#: Stops of the trail, and of its parts: entries, hubs, tests, guides.  Fixed values.
TRAIL, PARTS = 12, (8, 6, 2, 2)


def _first(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(most).withColumn("k", F.row_number().over(Window.orderBy(*order)))


def _or_none(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("none"))


def trail(files: DataFrame, edges: DataFrame) -> DataFrame:
    """place, path, role of a reading path: ways in, hubs, tests and guides; files: path; edges: src, dst of local imports."""
    source = files.where(F.col("path").rlike(SOURCE)).select("path")
    used = edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("users"))
    entries = _first(source.where(F.col("path").rlike(ENTRY)), PARTS[0], "path").select(F.lit(1).alias("part"), "k", "path", F.lit("entry").alias("role"))
    hubs = _first(source.join(used, "path"), PARTS[1], F.desc("users"), "path").select(F.lit(2).alias("part"), "k", "path", F.lit("hub").alias("role"))
    tests = _first(source.where(F.col("path").rlike(TEST)), PARTS[2], "path").select(F.lit(3).alias("part"), "k", "path", F.lit("test").alias("role"))
    guides = _first(files.where(F.col("path").rlike(GUIDE)).select("path"), PARTS[3], "path").select(F.lit(4).alias("part"), "k", "path", F.lit("guide").alias("role"))
    every = entries.unionByName(hubs.join(entries.select("path"), "path", "left_anti").select("part", "k", "path", "role")).unionByName(tests).unionByName(guides)
    placed = every.withColumn("place", F.row_number().over(Window.orderBy("part", "k")))  # eighteen rows at most
    return placed.where(F.col("place") <= TRAIL).select("place", "path", "role")


def first_tasks(files: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """place, task, path, reason: what a newcomer could do first, from what a repository lacks and what it leans on."""
    source = files.where(F.col("path").rlike(SOURCE))
    n = files.agg(
        F.count_if(F.col("path").rlike(GUIDE)).alias("guides"), F.count_if(F.col("path").rlike(SOURCE)).alias("sources"), F.count_if(F.col("path").rlike(SOURCE) & F.col("path").rlike(TEST)).alias("tests"),
        F.count_if(F.col("path").rlike(MANIFEST)).alias("manifests"), F.min(F.when(F.col("path").rlike(SOURCE), F.struct((~F.col("path").rlike(ENTRY)).alias("inner"), "path")))["path"].alias("start"),
    )
    hub = source.select("path").join(edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("users")), "path").agg(F.min(F.struct((-F.col("users")).alias("less"), "path")).alias("h"))
    one = n.join(F.broadcast(hub))
    row = lambda when, place, task, path, reason: F.when(when, F.struct(F.lit(place).alias("at"), F.lit(task).alias("task"), path.alias("path"), reason.alias("reason")))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    tasks = F.array_compact(F.array(
        row(F.col("guides") == 0, 1, "write a quickstart", F.coalesce("start", F.lit("")), F.lit("no guide is to be found")),
        row((F.col("tests") == 0) & (F.col("sources") > 0), 2, "add a first test", F.col("start"), text("no test beside ", F.col("sources").cast("string"), " source files")),
        row(F.col("h").isNotNull(), 3, "trace the most imported file", F.col("h.path"), text((-F.col("h.less")).cast("string"), " files import it")),
        row((F.col("manifests") == 0) & (F.col("sources") > 0), 4, "write down what it runs on", F.col("start"), F.lit("no manifest is to be found")),
    ))
    return one.select(F.posexplode(F.slice(tasks, 1, most)).alias("p", "t")).select((F.col("p") + 1).alias("place"), "t.task", "t.path", "t.reason")


def first_contribution(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One text (Markdown) of inventory, trail and tasks."""
    has = lambda rx: F.count_if(F.col("path").rlike(rx)).cast("string")
    head = files.agg(F.concat(F.lit("# First contribution\n\n"), F.count(F.lit(1)).cast("string"), F.lit(" files, "), has(SOURCE), F.lit(" of source, "), F.count_if(F.col("path").rlike(SOURCE) & F.col("path").rlike(TEST)).cast("string"), F.lit(" tests, "), has(GUIDE), F.lit(" guides")).alias("head"))
    lines = lambda df, line: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    path = lines(trail(files, edges), F.concat(F.lit("- "), "role", F.lit(": `"), "path", F.lit("`"))).withColumnRenamed("t", "trail")
    todo = lines(first_tasks(files, edges), F.concat(F.col("place").cast("string"), F.lit(". "), "task", F.lit(" (`"), "path", F.lit("`): "), "reason")).withColumnRenamed("t", "tasks")
    one = head.join(F.broadcast(path)).join(F.broadcast(todo))
    return one.select(F.concat("head", F.lit("\n\n## Trail\n\n"), "trail", F.lit("\n\n## Tasks\n\n"), "tasks", F.lit("\n")).alias("text"))


def links_view(facts: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """node, text: a file's role, how many import it and are imported, and the first ``most`` of both."""
    near = G.neighbours(edges, most).groupBy("node").pivot("side", ["importer", "import"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list("other")), lambda x: x.cast("string")), ", "))
    f = facts.withColumn("role", G.role()).join(near, "node", "left")
    n = lambda c: F.col(c).cast("string")
    text = F.concat("name", F.lit(" ("), "role", F.lit(")\nimports "), n("fan_out"), F.lit(": "), _or_none("import"), F.lit("\nimported by "), n("fan_in"), F.lit(": "), _or_none("importer"))
    return f.select("node", text.alias("text"))


def log_view(commits: DataFrame, most: int = 15) -> DataFrame:
    """place, commit, author, day, files of the newest commits; commits: commit, author, day, path."""
    whole = commits.groupBy("commit", "author", "day").agg(F.count("path").alias("files"))
    return _first(whole, most, F.desc("day"), "commit").select(F.col("k").alias("place"), "commit", "author", "day", "files")


def overview_sheet(facts: DataFrame, folder_edges: DataFrame, most: int = 6) -> DataFrame:
    """One sheet of facts: folders with their files, traffic between them, entries, and the most imported files."""
    sizes = facts.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("folder", "n"))), lambda x: F.concat(x["folder"], F.lit(" "), x["n"].cast("string"))), ", ").alias("folders"))
    busy = _first(folder_edges, TRAFFIC, F.desc("n"), "src_folder", "dst_folder")
    traffic = busy.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "src_folder", "dst_folder", "n"))), lambda x: F.concat(x["src_folder"], F.lit(" to "), x["dst_folder"], F.lit(" "), x["n"].cast("string"))), ", ").alias("traffic"))
    ways = _first(facts.where("is_entry"), TRAFFIC, "node")
    entries = ways.agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ", ").alias("entries"))
    hubs = _first(facts.where("fan_in >= 2"), most, F.desc("fan_in"), "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "node", "fan_in"))), lambda x: F.concat(x["node"].cast("string"), F.lit(" "), x["fan_in"].cast("string"))), ", ").alias("hubs"))
    one = sizes.join(F.broadcast(traffic)).join(F.broadcast(entries)).join(F.broadcast(hubs))
    part = lambda title, c: F.concat(F.lit(title + ": "), _or_none(c))
    return one.select(F.concat_ws("\n", part("Files by folder", "folders"), part("Imports between folders", "traffic"), part("Entries", "entries"), part("Most imported", "hubs")).alias("sheet"))


#: Shares of a folder's links of which the first are taken apart.  Fixed value.
SHARES = 64


def folder_sheets(facts: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """folder, sheet: a folder's traffic inside, outward and inward (of either the first ``most``)."""
    a, b = facts.select(F.col("node").alias("src"), F.col("folder").alias("f")), facts.select(F.col("node").alias("dst"), F.col("folder").alias("t"))
    e = stage(edges.join(a, "src").join(b, "dst").select("src", "dst", "f", "t"), "sheet-edges")
    pair = F.concat(F.col("src").cast("string"), F.lit(" to "), F.col("dst").cast("string"))
    rows = e.where("f = t").select(F.col("f").alias("folder"), F.lit("inside").alias("way"), "src", "dst").unionByName(e.where("f <> t").select(F.col("f").alias("folder"), F.lit("outward").alias("way"), "src", "dst")).unionByName(e.where("f <> t").select(F.col("t").alias("folder"), F.lit("inward").alias("way"), "src", "dst"))
    first = lambda *by: F.row_number().over(Window.partitionBy("folder", "way", *by).orderBy("src", "dst"))
    # folders are few: the first of each share, then the first of those
    dealt = spread(rows.withColumn("share", F.pmod(F.xxhash64("src", "dst"), F.lit(SHARES))), 2 * e.count(), "folder", "way", "share")
    some = dealt.withColumn("k", first("share")).where(F.col("k") <= most).drop("k", "share")
    kept = some.withColumn("k", first()).where(F.col("k") <= most)
    one = kept.groupBy("folder").pivot("way", ["inside", "outward", "inward"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", pair.alias("t")))), lambda x: x["t"]), "; "))
    sizes = facts.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    part = lambda c: F.concat(F.lit(c + ": "), _or_none(c))
    return sizes.join(one, "folder", "left").select("folder", F.concat_ws("\n", F.concat("folder", F.lit(": "), F.col("n").cast("string"), F.lit(" files")), part("inside"), part("outward"), part("inward")).alias("sheet"))
