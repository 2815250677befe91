"""Configuration files with indentation (YAML) as rows: workflows, and services of compose files.

``entries`` folds the lines of a text with a stack of what is open: each line closes
what is not above it, and tells the path of names that it stands under.  List items are
named ``#`` and their line.  Everything else is filters over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import stage


_STACK = "array<struct<indent:int,name:string,item:boolean>>"
_ROWS = "array<struct<path:array<string>,name:string,value:string,line:int>>"
_KEY = r"""^("[^"]*"|'[^']*'|[^\s:#"'\[{-][^:]*?|-[^\s:][^:]*?)\s*:(?:\s+(.*))?$"""
#: Compose files in the order in which they are looked for.  Fixed values.
COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
#: Where a job runs that does not say so.  Fixed value.
RUNNER = "ubuntu-latest"


def _bare(value: Column) -> Column:
    """A value without its comment and quotes."""
    quoted = r"""^\s*(?:"([^"]*)"|'([^']*)')\s*(?:#.*)?$"""
    plain = F.trim(F.regexp_replace(F.concat(F.lit(" "), value), r"\s#.*$", ""))
    return F.when(value.rlike(quoted), F.concat(F.regexp_extract(value, quoted, 1), F.regexp_extract(value, quoted, 2))).otherwise(plain)


def entries(text: Column) -> Column:
    """Array of path, name, value, line of every name and every list item without one; blocks of text are one value."""

    def step(acc: Column, x: Column) -> Column:
        line = F.regexp_replace(x["text"], r"\s+$", "")
        body = F.regexp_replace(line, r"^\s+", "")
        indent = F.length(line) - F.length(body)
        in_block = (acc["block"] >= 0) & ((body == "") | (indent > acc["block"]))
        dash = body.rlike(r"^-(\s|$)")
        inner = F.when(dash, F.regexp_replace(body, r"^-\s*", "")).otherwise(body)
        named = inner.rlike(_KEY)
        name, value = _bare(F.regexp_extract(inner, _KEY, 1)), F.when(named, F.regexp_extract(inner, _KEY, 2)).otherwise(inner)
        at = indent + F.length(body) - F.length(inner)
        open_ = F.filter(acc["stack"], lambda e: (e["indent"] < indent) | (dash & (e["indent"] == indent) & ~e["item"]))
        entry = lambda i, n, item: F.array(F.struct(i.cast("int").alias("indent"), n.alias("name"), F.lit(item).alias("item")))
        under = F.when(dash, F.concat(open_, entry(indent, F.concat(F.lit("#"), x["line"].cast("string")), True))).otherwise(open_)
        row = F.struct(F.transform(under, lambda e: e["name"]).alias("path"), F.when(named, name).otherwise("").alias("name"), _bare(value).alias("value"), x["line"].alias("line"))
        opens = value.rlike(r"^[|>][+-]?\d?\s*(#.*)?$")
        last = F.try_element_at(acc["rows"], F.lit(-1))
        more = F.struct(last["path"].alias("path"), last["name"].alias("name"), F.concat_ws("\n", F.nullif(last["value"], F.lit("")), body).alias("value"), last["line"].alias("line"))
        grown = F.concat(F.slice(acc["rows"], F.lit(1), F.greatest(F.size(acc["rows"]) - 1, F.lit(0))), F.array(more))
        new = F.struct(
            F.when(named, F.concat(under, entry(at, name, False))).otherwise(under).alias("stack"),
            F.concat(acc["rows"], F.array(F.when(opens, F.struct(row["path"].alias("path"), row["name"].alias("name"), F.lit("").alias("value"), row["line"].alias("line"))).otherwise(row))).alias("rows"),
            F.when(opens, at).otherwise(-1).alias("block"),
        )
        kept = F.struct(acc["stack"].alias("stack"), F.when(body == "", acc["rows"]).otherwise(grown).alias("rows"), acc["block"].alias("block"))
        skipped = (body == "") | body.startswith("#") | body.rlike(r"^(---|\.\.\.)(\s|$)") | (~named & ~dash)
        return F.when(in_block, kept).when(skipped, acc).otherwise(new)

    lines = F.transform(F.split(F.regexp_replace(text, "\t", "  "), r"\r?\n"), lambda t, i: F.struct(t.alias("text"), (i + 1).alias("line")))
    start = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(_ROWS).alias("rows"), F.lit(-1).alias("block"))
    return F.aggregate(lines, start, step, lambda a: a["rows"])


def listed(value: Column) -> Column:
    """A value as a list: ``[a, b]`` or one alone."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    many = F.filter(F.transform(F.split(inner, ","), lambda x: _bare(F.trim(x))), lambda x: x != "")
    return F.when(value.rlike(r"^\[.*\]$"), many).when(value == "", F.array().cast("array<string>")).otherwise(F.array(value))


def _read(files: DataFrame) -> DataFrame:
    """file, p (path of names), name, value, line; files: path, text.  Texts are read once, however often their rows are."""
    rows = files.select(F.col("path").alias("file"), F.explode(entries(F.coalesce("text", F.lit(""))))).select("file", F.col("col.path").alias("p"), "col.name", "col.value", "col.line")
    return stage(rows, "config-rows")


def _many(rows: DataFrame, depth: int, name: str, *keys: str) -> DataFrame:
    """keys, found: the values of a list under a name, inline or by items, in order."""
    at = F.get("p", F.lit(depth))
    inline = rows.where((F.size("p") == depth) & (F.col("name") == name)).select(*keys, F.explode(F.transform(listed(F.col("value")), lambda v, i: F.struct(F.col("line").alias("line"), i.alias("i"), v.alias("v")))).alias("x"))
    items = rows.where((F.size("p") == depth + 2) & (at == name) & (F.col("name") == "")).select(*keys, F.struct(F.col("line").alias("line"), F.lit(0).alias("i"), F.col("value").alias("v")).alias("x"))
    return inline.unionByName(items).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("found"))


def workflows(files: DataFrame) -> DataFrame:
    """file, name, triggers, job, job_name, runs_on, needs, steps (name, uses, run) of every job of every workflow.

    A workflow without jobs is one row without a job.  files: path, text; those directly
    in ``.github/workflows`` with the endings yml and yaml are read.
    """
    rows = _read(files.where(F.col("path").rlike(r"(?i)^\.github/workflows/[^/]+\.ya?ml$")))
    key, size = lambda k: F.get("p", F.lit(k)), F.size("p")
    top = rows.groupBy("file").agg(F.min_by("value", F.when((size == 0) & (F.lower("name") == "name") & (F.col("value") != ""), F.col("line"))).alias("name"))
    base = F.regexp_replace(F.substring_index("file", "/", -1), r"(?i)\.ya?ml$", "")
    events = rows.where((size == 1) & (key(0) == "on") & (F.col("name") != "")).select("file", F.struct("line", F.lit(0).alias("i"), F.col("name").alias("v")).alias("x"))
    told = rows.where(((size == 0) & (F.col("name") == "on")) | ((size == 2) & (key(0) == "on") & (F.col("name") == "")))
    told = told.select("file", F.explode(F.transform(listed(F.col("value")), lambda v, i: F.struct(F.col("line").alias("line"), i.alias("i"), v.alias("v")))).alias("x"))
    triggers = events.unionByName(told).groupBy("file").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"])).alias("triggers"))
    inside = rows.where(key(0) == "jobs")
    jobs = inside.where((size == 1) & (F.col("name") != "")).select("file", F.col("name").alias("job"), F.col("line").alias("at"))
    own = inside.where((size == 2) & ~key(1).startswith("#")).withColumn("job", key(1))
    said = lambda name: F.max(F.when((F.col("name") == name) & (F.col("value") != ""), F.col("value")))
    facts = own.groupBy("file", "job").agg(said("name").alias("job_name"), said("runs-on").alias("runs_on"))
    needs = _many(inside.withColumn("job", key(1)), 2, "needs", "file", "job").withColumnRenamed("found", "needs")
    step = inside.where((size == 4) & (key(2) == "steps")).select("file", key(1).alias("job"), F.substring(key(3), 2, 20).cast("int").alias("at"), "name", "value")
    step = step.groupBy("file", "job", "at").agg(said("name").alias("name"), said("uses").alias("uses"), said("run").alias("run"))
    steps = step.groupBy("file", "job").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "uses", "run", F.lit("Step")).alias("name"), "uses", "run"))), lambda s: F.struct(s["name"], s["uses"], s["run"])).alias("steps"))
    out = top.join(triggers, "file", "left").join(jobs, "file", "left").join(facts, ["file", "job"], "left").join(needs, ["file", "job"], "left").join(steps, ["file", "job"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        "file", F.coalesce("name", base).alias("name"), F.coalesce("triggers", none).alias("triggers"), "job", F.coalesce("job_name", "job").alias("job_name"),
        F.when(F.col("job").isNotNull(), F.coalesce("runs_on", F.lit(RUNNER))).alias("runs_on"), F.coalesce("needs", none).alias("needs"),
        F.coalesce("steps", F.array().cast("array<struct<name:string,uses:string,run:string>>")).alias("steps"), "at",
    )


def workflow_lines(jobs: DataFrame) -> DataFrame:
    """file, lines: a workflow as text, a line a job with what it waits for and how many steps it has."""
    needs = F.when(F.size("needs") > 0, F.concat(F.lit(" after "), F.array_join("needs", ", "))).otherwise("")
    line = F.concat(F.lit("  "), "job_name", F.lit(" on "), "runs_on", needs, F.lit(": "), F.size("steps").cast("string"), F.when(F.size("steps") == 1, " step").otherwise(" steps"))
    head = F.concat("name", F.when(F.size("triggers") > 0, F.concat(F.lit(" (on "), F.array_join("triggers", ", "), F.lit(")"))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("job").isNotNull(), F.struct("at", line.alias("t"))))), lambda x: x["t"])
    return jobs.groupBy("file").agg(F.concat(F.array(F.first(head)), lines).alias("lines")).select("file", F.array_join("lines", "\n").alias("lines"))


def compose(files: DataFrame) -> DataFrame:
    """file, name, image, build, ports, depends of every service of the root's first compose file; files: path, text."""
    rank = F.array_position(F.array(*map(F.lit, COMPOSE)), F.col("path"))
    first = files.where(F.col("path").isin(*COMPOSE)).orderBy(rank).limit(1)
    return services(first)


def services(files: DataFrame) -> DataFrame:
    """The same of every file that is given."""
    rows = _read(files).where(F.get("p", F.lit(0)) == "services")
    key, size = lambda k: F.get("p", F.lit(k)), F.size("p")
    names = rows.where((size == 1) & (F.col("name") != "")).select("file", F.col("name").alias("service"), F.col("line").alias("at"))
    under = rows.withColumn("service", key(1))
    said = lambda test: F.max(F.when(test & (F.col("value") != ""), F.col("value")))
    one = under.where(size >= 2).groupBy("file", "service").agg(
        said((size == 2) & (F.col("name") == "image")).alias("image"),
        F.coalesce(said((size == 2) & (F.col("name") == "build")), said((size == 3) & (key(2) == "build") & (F.col("name") == "context"))).alias("build"),
    )
    ports = _many(under, 2, "ports", "file", "service").select("file", "service", F.filter(F.transform("found", lambda v: F.regexp_extract(v, r"^(\d+:\d+)", 1)), lambda v: v != "").alias("ports"))
    maps = under.where((size == 3) & (key(2) == "depends_on") & (F.col("name") != "")).select("file", "service", F.col("name").alias("value"))
    lists = _many(under, 2, "depends_on", "file", "service").select("file", "service", F.explode("found").alias("value"))
    depends = maps.unionByName(lists).groupBy("file", "service").agg(F.array_sort(F.collect_set("value")).alias("depends"))
    out = names.join(one, ["file", "service"], "left").join(ports, ["file", "service"], "left").join(depends, ["file", "service"], "left")
    none = F.array().cast("array<string>")
    return out.select("file", F.col("service").alias("name"), "image", "build", F.coalesce("ports", none).alias("ports"), F.coalesce("depends", none).alias("depends"), "at")


def service_folders(found: DataFrame, folders: DataFrame) -> DataFrame:
    """The services that are built from a folder of the scan, with that folder (empty: the root); folders: path."""
    clean = F.regexp_replace(F.regexp_replace("build", r"^\.(/|$)", ""), "/+$", "")
    known = folders.select(F.col("path").alias("folder")).unionByName(folders.sparkSession.createDataFrame([("",)], "folder string")).distinct()
    return found.where("build is not null").withColumn("folder", clean).join(known, "folder")
