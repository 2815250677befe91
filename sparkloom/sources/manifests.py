"""Dependencies out of manifests and findings out of tool reports, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import code as C


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), C.js_trim)


def requirements(text: Column) -> Column:
    """Names in a requirements file, without versions, options and comments."""
    names = F.transform(F.filter(_lines(text), lambda x: x.rlike(r"^[A-Za-z0-9]")), lambda x: F.lower(F.regexp_extract(x, r"^([A-Za-z0-9._-]+)", 1)))
    return F.array_sort(F.array_distinct(names))


def go_modules(text: Column) -> Column:
    """Modules that a go.mod file requires, in a block or alone."""
    found = F.transform(_lines(text), lambda x: F.regexp_extract(x, r"^(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v\S+", 1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def crates(text: Column) -> Column:
    """Names in the dependency sections of a Cargo.toml file."""

    def step(acc: Column, line: Column) -> Column:
        section = F.when(line.startswith("["), line.rlike(r"^\[(.*\.)?(dev-|build-)?dependencies\]$")).otherwise(acc["on"])
        name = F.regexp_extract(line, r"^([A-Za-z0-9_-]+)\s*=", 1)
        return F.struct(section.alias("on"), F.when(section & (name != ""), F.concat(acc["names"], F.array(name))).otherwise(acc["names"]).alias("names"))

    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("names"))
    return F.aggregate(_lines(text), start, step, lambda a: F.array_sort(F.array_distinct(a["names"])))


PACKAGE = "name string, license string, main string, bin string, workspaces string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>"


def package_json(text: Column) -> Column:
    return F.from_json(text, PACKAGE)


def entry_points(package: Column) -> Column:
    """Paths that a package names as its ways in: main, then bin, alone or by names."""
    named = F.map_values(F.from_json(package["bin"], "map<string,string>"))
    bins = F.when(package["bin"].startswith("{"), named).when(package["bin"].isNotNull(), F.array(package["bin"])).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array_compact(F.array(package["main"])), bins)
    return F.transform(F.filter(every, lambda p: p != ""), lambda p: F.regexp_replace(p, r"^\./", ""))


def workspaces(package: Column) -> Column:
    """Folders of a package's workspaces, a list or one under ``packages``, without a slash at the end."""
    raw = package["workspaces"]
    found = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.from_json(raw, "struct<packages:array<string>>")["packages"])
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda w: F.regexp_replace(w, "/$", ""))


def has_server(package: Column) -> Column:
    """Whether a script starts, serves or develops something."""
    return F.exists(F.coalesce(F.map_keys(package["scripts"]), F.array().cast("array<string>")), lambda s: s.rlike("start|serve|dev"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """repo, name, version, ecosystem, dev of all manifests (repo, file, text)."""
    file = F.substring_index("file", "/", -1)
    npm = manifests.where(file == "package.json").select("repo", package_json(F.col("text")).alias("p"))
    parts = [npm.select("repo", F.explode(F.col(f"p.{c}")).alias("name", "version"), F.lit("npm").alias("ecosystem"), F.lit(dev).alias("dev")) for c, dev in (("dependencies", False), ("devDependencies", True))]
    for name, parse, eco in (("requirements.txt", requirements, "pip"), ("go.mod", go_modules, "go"), ("Cargo.toml", crates, "cargo")):
        found = manifests.where(file == name).select("repo", F.explode(parse(F.col("text"))).alias("name"))
        parts.append(found.select("repo", "name", F.lit("*").alias("version"), F.lit(eco).alias("ecosystem"), F.lit(False).alias("dev")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("version", C.clean_version(F.col("version")))


def procfile(text: Column) -> Column:
    """Services of a Procfile: name and command."""
    rows = F.filter(_lines(text), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:"))
    return F.transform(rows, lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("command")))


SEMGREP = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string,lines:string>>>>"
GITLEAKS = "array<struct<RuleID:string,File:string,StartLine:int,Description:string>>"


def semgrep(text: Column) -> Column:
    return F.transform(F.from_json(text, SEMGREP)["results"], lambda r: F.struct(r["path"].alias("path"), r["start"]["line"].alias("line"), r["check_id"].alias("rule"), C.normalize_severity(r["extra"]["severity"]).alias("severity"), F.lit("semgrep").alias("tool")))


def gitleaks(text: Column) -> Column:
    """Secrets are never read: only where they are."""
    return F.transform(F.from_json(text, GITLEAKS), lambda r: F.struct(r["File"].alias("path"), r["StartLine"].alias("line"), r["RuleID"].alias("rule"), F.lit("critical").alias("severity"), F.lit("gitleaks").alias("tool")))


def vulture(text: Column, least: int = 60) -> Column:
    """Unused code by line, with a confidence of ``least`` percent at least."""
    rx = r"^(.+):(\d+): (.+) \((\d+)% confidence\)$"
    rows = F.filter(_lines(text), lambda x: x.rlike(rx) & (F.regexp_extract(x, rx, 4).cast("int") >= least))
    return F.transform(rows, lambda x: F.struct(F.regexp_extract(x, rx, 1).alias("path"), F.regexp_extract(x, rx, 2).cast("int").alias("line"), F.lit("unused-code").alias("rule"), F.lit("low").alias("severity"), F.lit("vulture").alias("tool")))


KNIP = "files array<string>, dependencies array<string>, unused array<struct<name:string,file:string,line:int>>, unresolved array<struct<name:string,file:string,line:int>>"


def _finding(path: Column, line: Column, rule: str, severity: str, tool: str, what: Column) -> Column:
    return F.struct(path.alias("path"), F.coalesce(line, F.lit(1)).alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(tool).alias("tool"), what.alias("what"))


def knip(text: Column) -> Column:
    """Unused files, dependencies and exports, and imports that lead nowhere; ``what`` is their name."""
    r = F.from_json(text, KNIP)
    none = F.array().cast("array<struct<path:string,line:int,rule:string,severity:string,tool:string,what:string>>")
    names = lambda key, rule, severity: F.coalesce(F.transform(r[key], lambda x: _finding(x, F.lit(1), rule, severity, "knip", x)), none)
    places = lambda key, rule, severity: F.coalesce(F.transform(r[key], lambda x: _finding(x["file"], x["line"], rule, severity, "knip", x["name"])), none)
    return F.concat(names("files", "knip:unused-file", "medium"), names("dependencies", "knip:unused-dependency", "low"), places("unused", "knip:unused-export", "low"), places("unresolved", "knip:unresolved", "medium"))


def depcheck(text: Column) -> Column:
    """Declared packages that nothing imports, by manifest; those for development say so."""
    r = F.from_json(text, "dependencies array<string>, devDependencies array<string>")
    of = lambda key, dev: F.coalesce(F.transform(r[key], lambda x: F.struct(*(_finding(F.lit("package.json"), F.lit(1), "depcheck:unused", "low", "depcheck", x)[c].alias(c) for c in ("path", "line", "rule", "severity", "tool", "what")), F.lit(dev).alias("dev"))), F.array().cast("array<struct<path:string,line:int,rule:string,severity:string,tool:string,what:string,dev:boolean>>"))
    return F.concat(of("dependencies", False), of("devDependencies", True))


def engine_rows(status: DataFrame, passes: DataFrame) -> DataFrame:
    """Every tool (id, label, kind, available) with its last run (id, ok, available, findings, ms, reason), if there was one."""
    p = passes.select("id", "ok", F.col("available").alias("was"), F.col("findings").alias("n"), F.col("ms").alias("took"), "reason")
    ok, failed = F.coalesce("ok", F.lit(False)), F.coalesce(~F.col("ok") & F.col("was"), F.lit(False))
    return status.join(p, "id", "left").select(
        "id", F.coalesce("label", "id").alias("label"), F.coalesce("kind", F.lit("security")).alias("kind"), F.coalesce("available", F.lit(False)).alias("available"),
        ok.alias("ran"), failed.alias("failed"), F.when(ok, F.col("n")).otherwise(0).cast("long").alias("findings"), F.when(ok, F.col("took")).alias("ms"), F.when(failed, F.col("reason")).alias("failure"),
    )


def engine_summary(rows: DataFrame, ran_once: bool = True) -> DataFrame:
    """tone (idle, none, clean, found) and counts in one line: nothing ran is never told as nothing found."""
    t = rows.agg(F.count(F.lit(1)).alias("tools"), F.count_if("ran").alias("ran"), F.count_if("failed").alias("failed"), F.count_if(~F.col("available")).alias("missing"), F.coalesce(F.sum("findings"), F.lit(0)).alias("found"))
    tone = F.when(~F.lit(ran_once), "idle").when(F.col("ran") == 0, "none").when(F.col("found") > 0, "found").otherwise("clean")
    count = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(what)))
    text = (
        F.when(tone == "idle", "No engine was run.").when((tone == "none") & (F.col("missing") == F.col("tools")) & (F.col("tools") > 0), "No engine is installed.").when(tone == "none", "No engine could run.")
        .otherwise(F.concat_ws(", ", F.concat(F.col("ran").cast("string"), F.lit(" of "), F.col("tools").cast("string"), F.lit(" ran")), F.concat(F.col("found").cast("string"), F.lit(" findings")), count("failed", " failed"), count("missing", " not installed")))
    )
    return t.select(tone.alias("tone"), text.alias("text"))
