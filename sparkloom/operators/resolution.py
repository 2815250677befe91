"""Imports to files, directories and packages, by one join.

Every file is known by keys: its path, its path without an ending, its directory if it
stands for it (``index.js``, ``__init__.py``, ``mod.rs``), its name, the last parts of
its directory.  An import has a short list of keys to try, best first.  The first key
that is known decides, and of the files of one key the one of the best rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import paths as P
from sparkloom.functions.code import let
from sparkloom.storage import stage

#: Endings of scripts in the order in which they are tried.  Fixed values.
SCRIPT_ENDINGS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")
#: Directories are known by so many last parts.  Fixed value.
TAIL = 3
_CONFIG = T.StructType().add("compilerOptions", T.StructType().add("baseUrl", T.StringType()).add("paths", T.MapType(T.StringType(), T.ArrayType(T.StringType()))))


def without_comments(text: Column) -> Column:
    """JSON with comments as JSON: comments outside strings go."""
    pieces = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"|/\*[\s\S]*?\*/|//[^\n]*|[^"/]+|[/"]'), F.lit(0))
    return F.array_join(F.filter(pieces, lambda p: ~(p.startswith("//") | p.startswith("/*"))), "")


def tsconfig(files: DataFrame) -> DataFrame:
    """base, pattern, targets: aliases of the tsconfig at the root, or the jsconfig if there is none that says anything.

    A row without pattern tells a base alone.  A configuration that can't be read counts as none.
    """
    read = files.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).select("path", F.from_json(without_comments(F.col("text")), _CONFIG)["compilerOptions"].alias("o"))
    base = F.regexp_replace(F.regexp_replace(F.coalesce("o.baseUrl", F.lit("")), r"^\.?/", ""), "/$", "")
    read = read.select("path", base.alias("base"), F.coalesce("o.paths", F.create_map().cast("map<string,array<string>>")).alias("paths")).where((F.size("paths") > 0) | (F.col("base") != ""))
    first = read.orderBy(F.desc("path")).limit(1)  # tsconfig comes after jsconfig
    return first.select("base", F.explode_outer("paths").alias("pattern", "targets"))


def go_module(files: DataFrame) -> DataFrame:
    """module: the path that the root's go.mod names; no row without one."""
    return files.where("path = 'go.mod'").select(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("module")).where("module <> ''").limit(1)


def aliased(specs: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, bases: for each specifier (column name) with a matching alias, the paths it may mean, best first.

    Aliases meet specifiers by what stands before their star (a specifier has as many
    beginnings as characters); exact patterns win, then longer beginnings, then longer ends.
    """
    star = F.instr("pattern", "*")
    known = aliases.where("pattern is not null").select(
        "base", "targets", (star > 0).alias("wild"), F.when(star > 0, F.left("pattern", star - 1)).otherwise(F.col("pattern")).alias("before"),
        F.when(star > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")).otherwise(F.lit("")).alias("after"),
    )
    begun = specs.select("name", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.left("name", k))).alias("before"))
    n, b, a = F.length("name"), F.length("before"), F.length("after")
    hit = begun.join(known, "before").where(F.when(F.col("wild"), F.endswith("name", F.col("after")) & (n >= b + a)).otherwise(n == b))
    best = hit.groupBy("name").agg(F.min_by(F.struct("base", "targets", F.substring("name", b + 1, n - b - a).alias("part")), F.struct("wild", -b, -a)).alias("x"))
    bases = F.transform(F.coalesce("x.targets", F.array().cast("array<string>")), lambda t: P.normalize(F.concat(F.col("x.base"), F.lit("/"), F.regexp_replace(t, r"^([^*]*)\*", F.concat(F.lit("$1"), _literal(F.col("x.part")))))))
    return best.select("name", bases.alias("bases"))


def _literal(replacement: Column) -> Column:
    return F.replace(F.replace(replacement, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _keyed(family: str, key: Column) -> Column:
    return F.concat(F.lit(family + ":"), key)


def keys_of(files: DataFrame) -> DataFrame:
    """key, rank, target, whole (the target is a directory) of all files and directories."""
    path, ext, name, folder = F.col("path"), P.ext_of(F.col("path")), P.name_of(F.col("path")), P.dir_of(F.col("path"))
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    at = F.array_position(F.array(*map(F.lit, SCRIPT_ENDINGS)), ext)
    row = lambda key, rank: F.struct(key.alias("key"), F.lit(rank).cast("int").alias("rank") if isinstance(rank, int) else rank.cast("int").alias("rank"))
    own = F.array_compact(F.array(
        row(_keyed("script", path), 0), row(_keyed("file", path), 0), F.when(at > 0, row(_keyed("script", stem), at)),
        F.when((at > 0) & (F.regexp_replace(name, r"\.[^.]*$", "") == "index"), row(_keyed("script", folder), at + 6)),
        F.when(at >= 5, row(_keyed("script", F.concat(stem, F.lit(".js"))), at + 8)), F.when(at >= 5, row(_keyed("script", F.concat(stem, F.lit(".jsx"))), at + 8)),
        F.when(ext == ".py", row(_keyed("python", stem), 0)), F.when((name == "__init__.py") & (folder != ""), row(_keyed("python", folder), 1)),
        F.when(ext == ".rs", row(_keyed("rust", stem), 0)), F.when(name == "mod.rs", row(_keyed("rust", folder), 1)), F.when(ext == ".java", row(_keyed("java", stem), 0)),
    ))
    single = files.select(F.explode(own).alias("k"), F.col("path").alias("target"), F.lit(False).alias("whole")).select("k.key", "k.rank", "target", "whole")
    named = files.groupBy(name.alias("n")).agg(F.min("path").alias("target")).select(_keyed("name", F.col("n")).alias("key"), F.lit(0).alias("rank"), "target", F.lit(False).alias("whole"))
    # directories in the order in which a walk over sorted paths meets them
    met = files.select("path", F.explode(P.ancestors(path)).alias("dir")).groupBy("dir").agg(F.min("path").alias("first"))
    folders = met.select(_keyed("dir", F.col("dir")).alias("key"), F.lit(0).alias("rank"), F.col("dir").alias("target"), F.lit(True).alias("whole"))
    parts = F.split("dir", "/")
    tails = met.where("dir <> ''").select("dir", "first", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(TAIL))), lambda k: F.array_join(F.slice(parts, -k, k), "/"))).alias("tail"))
    tails = tails.groupBy("tail").agg(F.min_by("dir", F.struct("first", -F.length("dir"))).alias("dir"))
    ended = tails.select(_keyed("tail", F.col("tail")).alias("key"), F.lit(0).alias("rank"), F.col("dir").alias("target"), F.lit(True).alias("whole"))
    members = files.where(ext == ".cs").select(folder.alias("dir"), stem.alias("stem"), path.alias("target")).join(tails, "dir")
    typed = members.select(F.concat(F.lit("type:"), F.col("tail"), F.lit("/"), P.name_of(F.col("stem"))).alias("key"), F.lit(0).alias("rank"), "target", F.lit(False).alias("whole"))
    return single.unionByName(named).unionByName(folders).unionByName(ended).unionByName(typed)


def _beginnings(parts: Column, least: Column | int = 1) -> Column:
    """Joined beginnings of an array, longest first, of ``least`` parts or more."""
    n, least = F.size(parts), F.lit(least) if isinstance(least, int) else least
    return F.when(n < least, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(n, least, F.lit(-1)), lambda k: F.slice(parts, F.lit(1), k)))


def _endings(parts: Column) -> Column:
    n = F.size(parts)
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, -k, k), "/")))


def _script_keys(path: Column, name: Column, bases: Column, base: Column) -> Column:
    relative = F.array(P.normalize(F.concat_ws("/", P.dir_of(path), name)))
    rooted = F.when(path.startswith("public/"), F.array(P.normalize(F.concat(F.lit("public/"), name)), P.normalize(name))).otherwise(F.array(P.normalize(name)))
    based = F.when(base != "", F.array(P.normalize(F.concat_ws("/", base, name)))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.when(name.startswith("."), relative).when(name.startswith("/"), rooted).otherwise(F.coalesce(bases, based)), lambda b: _keyed("script", b))


def _python_keys(path: Column, name: Column) -> Column:
    here = P.dir_of(path)
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.replace(F.substring(name, dots + 1, F.length(name)), F.lit("."), F.lit("/"))
    parts = F.when(here == "", F.array().cast("array<string>")).otherwise(F.split(here, "/"))
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")
    absolute = F.array(P.normalize(rest), P.normalize(F.concat_ws("/", here, rest)))
    return F.transform(F.when(dots > 0, F.array(P.normalize(F.concat_ws("/", up, rest)))).otherwise(absolute), lambda b: _keyed("python", b))


def _rust_keys(path: Column, name: Column) -> Column:
    here = F.regexp_extract(path, "^(.*/)[^/]*$", 1)
    crate = F.when(path.rlike("(^|/)src/"), F.regexp_extract(path, "^((?:.*/)?src/)", 1)).otherwise(here)
    module = F.when(P.name_of(path).isin("mod.rs", "lib.rs", "main.rs"), here).otherwise(F.concat(F.regexp_replace(path, r"\.rs$", ""), F.lit("/")))
    parts = F.array_remove(F.split(name, "::"), "")
    head = F.get(parts, F.lit(0))
    base = F.when(head == "crate", crate).when(head == "super", F.regexp_extract(F.regexp_replace(module, "/$", ""), "^(.*/)[^/]*$", 1)).otherwise(module)
    rest = F.when(head.isin("crate", "super", "self"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    keys = F.transform(_beginnings(rest), lambda b: F.concat(F.lit("rust:"), base, F.array_join(b, "/")))
    return F.when(name.startswith("::"), F.array().cast("array<string>")).otherwise(keys)


def _java_keys(path: Column, name: Column, static: Column, package: Column) -> Column:
    folder = F.replace(package, F.lit("."), F.lit("/"))
    mark = F.concat(F.lit("/"), folder, F.lit("/"))
    before = F.length(path) - F.instr(F.reverse(path), F.reverse(mark)) - F.length(mark) + 1
    root = F.when(F.contains(path, mark), F.left(path, before + 1)).when(path.startswith(F.concat(folder, F.lit("/"))), F.lit(""))
    parts = F.array_remove(F.split(name, r"\."), "")
    least = F.when(static & (F.size(parts) > 1), 2).otherwise(1)
    keys = F.transform(_beginnings(parts, least), lambda b: F.concat(F.lit("java:"), root, F.array_join(b, "/")))
    return F.when((package != "") & root.isNotNull(), keys).otherwise(F.array().cast("array<string>"))


def _csharp_keys(name: Column, static: Column) -> Column:
    parts = F.array_remove(F.split(name, r"\."), "")
    last = F.element_at(parts, -1)
    spaces = _endings(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    # of a type's namespace the longest end that is a directory decides alone
    types = F.flatten(F.transform(spaces, lambda s: F.array_compact(F.array(F.concat(F.lit("type:"), s, F.lit("/"), last), F.when(static, F.concat(F.lit("tail:"), s))))))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.concat(types, F.transform(_endings(parts), lambda s: _keyed("tail", s))))


def _generic_keys(path: Column, name: Column, detail: Column) -> Column:
    here = P.dir_of(path)
    clean = F.translate(F.replace(name, F.lit("::"), F.lit("/")), "\\.", "//")
    at, swept = P.normalize(F.concat_ws("/", here, name)), P.normalize(F.concat_ws("/", here, clean))
    last = F.regexp_extract(name, r"([^./\\:]*)$", 1)
    tries = [_keyed("file", at), *(_keyed("file", F.concat(x, F.lit(e))) for x, e in ((at, ".rb"), (swept, ".rb"), (swept, ".php"), (at, ".php")))]
    keys = F.array_compact(F.array(*tries, F.when(last != "", F.concat(F.lit("name:"), last, F.lit(".php"))), _keyed("name", P.name_of(name))))
    return F.when(detail == "system", F.array().cast("array<string>")).otherwise(keys)


def package_name(lang: Column, name: Column) -> Column:
    """The name of what lies outside: an npm scope and name, a first module, a host with two parts."""
    parts = F.split(name, "/")
    script = F.when(name.startswith("node:"), F.substring(name, 6, 1 << 20)).when(name.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))
    go = F.when(F.contains(F.get(parts, F.lit(0)), F.lit(".")), F.array_join(F.slice(parts, 1, 3), "/")).otherwise(F.get(parts, F.lit(0)))
    first = F.regexp_extract(name, r"^([^.:/\\]*)", 1)
    generic = F.when(name.rlike(r"\.(h|hpp)$") | (first == ""), name).otherwise(first)
    return F.when(lang.isin("javascript", "typescript"), script).when(lang == "python", F.substring_index(name, ".", 1)).when(lang == "go", go).otherwise(generic)


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """path, lang, line, name, names, target, package, outside, state of every import.

    found: rows of statements; files: path (and text, for configuration files) of all
    files.  ``state`` is file, package (a directory, in ``package``), outside (with its
    name) or unresolved.
    """
    imports = found.where("kind = 'import'").select("path", "lang", "line", "at", "name", "names", "detail")
    packages = found.where("kind = 'package'").groupBy("path").agg(F.first("name").alias("space"))
    imports = imports.join(packages, "path", "left").withColumn("space", F.coalesce("space", F.lit("")))
    has_text = "text" in files.columns
    empty = files.sparkSession.createDataFrame
    aliases = stage(tsconfig(files), "aliases") if has_text else empty([], "base string, pattern string, targets array<string>")
    module = go_module(files) if has_text else empty([], "module string")
    script = imports.where(F.col("lang").isin("javascript", "typescript") & ~F.col("name").rlike(r"^[./]")).select("name").distinct()
    bases = aliased(script, aliases).withColumn("for_script", F.lit(True))
    one = aliases.agg(F.coalesce(F.max("base"), F.lit("")).alias("base")).join(F.broadcast(module.agg(F.max("module").alias("module"))))
    imports = imports.withColumn("for_script", F.col("lang").isin("javascript", "typescript")).join(bases, ["name", "for_script"], "left").join(F.broadcast(one))  # one row
    path, lang, name, static = F.col("path"), F.col("lang"), F.col("name"), F.col("detail") == "static"
    local = (lang == "go") & F.col("module").isNotNull() & ((name == F.col("module")) | name.startswith(F.concat("module", F.lit("/"))))
    folder = F.regexp_replace(F.expr("substring(name, length(module) + 1)"), "^/", "")
    keys = (
        F.when(F.col("for_script"), _script_keys(path, name, F.col("bases"), F.col("base"))).when(lang == "python", _python_keys(path, name)).when(lang == "rust", _rust_keys(path, name))
        .when(lang == "java", _java_keys(path, name, static, F.col("space"))).when(lang == "csharp", _csharp_keys(name, static))
        .when(lang == "go", F.when(local, F.array(_keyed("dir", folder))).otherwise(F.array().cast("array<string>"))).otherwise(_generic_keys(path, name, F.col("detail")))
    )
    outside = (
        F.when(F.col("for_script"), ~name.rlike(r"^[./]") & F.col("bases").isNull()).when(lang == "python", ~name.startswith(".")).when(lang == "go", ~local)
        .when(lang.isin("rust", "java", "csharp"), F.lit(False)).otherwise(F.col("detail").isin("system", "require", "use"))
    )
    wanted = stage(imports.select("path", "lang", "line", "at", "name", "names", "detail", keys.alias("keys"), F.when(outside, package_name(lang, name)).alias("outside")), "imports")
    # each question is asked once, however many files put it
    asked = wanted.select("keys").where(F.size("keys") > 0).distinct().select("keys", F.posexplode("keys").alias("i", "key"))
    hit = asked.join(keys_of(files.select("path")), "key").groupBy("keys").agg(F.min_by(F.struct("key", "target", "whole"), F.struct("i", "rank", "target")).alias("h"))
    out = wanted.join(hit, "keys", "left")
    # a static import that meets the directory of its type's namespace, and no file there, is none
    stopped = (lang == "csharp") & static & F.col("h.whole")
    target = F.when(~F.col("h.whole"), F.col("h.target"))
    package = F.when(F.col("h.whole") & ~stopped, F.col("h.target"))
    state = F.when(target.isNotNull(), "file").when(package.isNotNull(), "package").when(F.col("outside").isNotNull() & ~F.coalesce(stopped, F.lit(False)), "outside").otherwise("unresolved")
    return out.select("path", "lang", "line", "name", "names", target.alias("target"), package.alias("package"), F.when(state == "outside", F.col("outside")).alias("outside"), state.alias("state"))


def edges(resolved: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """src, dst, symbols: each pair once, no loops; an import of a directory reaches every code file directly in it."""
    direct = resolved.where("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst"), "names")
    if files is not None:
        code = files.where(P.language_of(F.col("path")).isNotNull()).select(P.dir_of(F.col("path")).alias("package"), F.col("path").alias("dst"))
        direct = direct.unionByName(resolved.where("package is not null").join(code, "package").select(F.col("path").alias("src"), "dst", "names"))
    return direct.where("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("symbols"))


def tally(resolved: DataFrame) -> DataFrame:
    """total, internal, external, unresolved and confidence (percent of imports that were placed)."""
    t = resolved.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state").isin("file", "package")).alias("internal"), F.count_if(F.col("state") == "outside").alias("external"), F.count_if(F.col("state") == "unresolved").alias("unresolved"))
    return t.withColumn("confidence", F.when(F.col("total") == 0, F.lit(100).cast("long")).otherwise(F.floor(100.0 * (F.col("internal") + F.col("external")) / F.col("total") + 0.5)))


def worst(resolved: DataFrame, most: int = 12) -> DataFrame:
    """name, n, example: the imports that most often lead nowhere (a report of ``most`` rows)."""
    return resolved.where("state = 'unresolved'").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("example")).orderBy(F.desc("n"), "name").limit(most)
