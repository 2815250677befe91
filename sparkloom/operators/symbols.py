"""Imports, exports, functions, classes and calls of code files as rows.

``extract`` reads every file once, in the task that holds it, into rows of
statements (``grammar``); all that follows is joins and groups over these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import paths as P
from sparkloom.operators.grammar import statements
from sparkloom.storage import TASK_ROWS, small, spread, stage

_FIELDS = [
    ("path", pa.string()), ("lang", pa.string()), ("kind", pa.string()), ("detail", pa.string()), ("name", pa.string()), ("names", pa.list_(pa.string())), ("line", pa.int32()),
    ("at", pa.int32()), ("start", pa.int32()), ("until", pa.int32()), ("size", pa.int32()),
]
ROWS = "path string, lang string, kind string, detail string, name string, names array<string>, line int, at int, start int, until int, size int"
#: Rows of a batch that a task sends back.
BATCH = 10_000


def extract(files: DataFrame) -> DataFrame:
    """A row for every statement of every file: see ``ROWS``.

    ``line`` is 1 for the first; ``at`` is a statement's place, ``start`` and ``until``
    those of a function's body, in characters; ``size`` counts the type parameters of a
    class.  ``names`` are imported names, annotations, or a method's receiver.
    """

    told = itemgetter(*(name for name, _ in _FIELDS[2:]))

    def columns(rows: list[tuple[object, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows) if rows else [()] * len(_FIELDS), _FIELDS)], schema=pa.schema(_FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[object, ...]] = []
            for path, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [(path, lang, *told(r)) for r in statements(path, lang, text or "")]
                if len(rows) >= BATCH:
                    yield columns(rows)
                    rows = []
            yield columns(rows)

    return files.select("path", "lang", "text").mapInArrow(run, ROWS)


def exports(found: DataFrame) -> DataFrame:
    """path, name, kind of what a file offers, by the rules of its language; each name once."""
    public = F.when(F.col("lang") == "python", ~F.col("name").startswith("_") & (F.col("detail") != "method"))
    public = public.when(F.col("lang") == "go", (F.col("kind") == "function") & F.col("name").rlike("^[A-Z]")).when(F.col("lang") == "rust", F.col("detail") == "pub")
    public = public.when(F.col("lang").isin("java", "csharp"), F.col("kind") == "class").otherwise(F.lit(False))
    offered = found.where((F.col("kind") == "export") | (F.col("kind").isin("function", "class") & public))
    kind = F.when(F.col("kind") == "export", F.col("detail")).when((F.col("lang") == "go"), F.col("detail")).otherwise(F.col("kind"))
    return offered.groupBy("path", "name").agg(F.min_by(kind, F.struct("at", kind)).alias("kind"))


def calls(found: DataFrame, innermost: bool = False) -> DataFrame:
    """path, caller, callee, line of the first call: functions of a file that call others of it.

    A call belongs to every function whose body it lies in, or, with ``innermost``, to
    the smallest.  Calls and bodies meet by file, so a pair is looked at only within one.
    """
    bodies = found.where("kind = 'function' and start is not null and until is not null").select("path", F.col("name").alias("caller"), "start", "until")
    made = found.where("kind = 'call'").select("path", F.col("name").alias("callee"), F.col("at").alias("place"), "line")
    inside = made.join(bodies, "path").where("place > start and place < until")
    if innermost:
        inside = inside.groupBy("path", "callee", "place", "line").agg(F.max_by("caller", "start").alias("caller"))
    return inside.where("caller <> callee").groupBy("path", "caller", "callee").agg(F.min("line").alias("line"))


def used_names(resolved: DataFrame) -> DataFrame:
    """path, name: names that imports take from files; ``*`` for whole files."""
    hit = resolved.where("target is not null")
    return hit.select(F.col("target").alias("path"), F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("*")))).alias("name")).distinct()


def dead_exports(exports: DataFrame, used: DataFrame, spared: DataFrame) -> DataFrame:
    """Exports (path, name) that nobody imports by name; files imported as a whole (name ``*``) or spared are left out."""
    whole = used.where("name = '*'").select("path").distinct()
    left = exports.join(small(spared), "path", "left_anti").join(whole, "path", "left_anti")
    return left.join(used.select("path", "name").distinct(), ["path", "name"], "left_anti")


#: Imports in a list, files and imports of a block of pairs, about.  Spark holds all pairs of one list at a time, so
#: lists and files of a block stay few.  Fixed values.
LIST = 64
DOWN = 1024
ACROSS = 16_384


def package_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports of a package (a directory) reach every file directly in it.

    The pairs may be far more than both sides: each side holds a row once, and both are cut into blocks, so
    that a task's work is bounded however large a package is.  Imports come in short lists, each taken apart
    beside one file after the other: neighbouring rows are alike, which keeps what is written of them small.
    """
    members = files.select(P.dir_of(F.col("path")).alias("package"), F.col("path").alias("dst")).distinct()
    asked = imports.select("package", F.col("path").alias("src")).distinct()
    count = lambda df, name: df.groupBy("package").agg(F.count(F.lit(1)).alias(name))
    cut = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = stage(count(asked, "a").join(count(members, "m"), "package").select("*", cut("a", LIST).alias("lists"), cut("a", ACROSS).alias("across"), cut("m", DOWN).alias("down")), "packages")
    # as many parts as full blocks, or as the rows of both sides ask for where packages are small
    blocks, most = sizes.agg(F.sum(F.col("a") * F.col("m") / (DOWN * ACROSS)), F.sum(F.greatest(F.col("a") * F.col("down"), F.col("m") * F.col("across")))).first()
    dealt = lambda df: spread(df, max(int(blocks or 0) * TASK_ROWS, most or 0), "package", "row", "col").hint("merge")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = small(sizes.drop("a", "m"))
    lists = asked.join(known, "package").groupBy("package", "across", "down", F.pmod(F.xxhash64("src"), "lists").alias("k")).agg(F.collect_list("src").alias("every"))
    left = dealt(lists.select("package", upto("down").alias("row"), F.pmod("k", "across").cast("int").alias("col"), "every"))
    right = dealt(members.join(known, "package").select("package", F.pmod(F.xxhash64("dst"), "down").cast("int").alias("row"), "dst", upto("across").alias("col")))
    return left.join(right, ["package", "row", "col"]).select(F.explode("every").alias("src"), "dst").where("src <> dst")


def directories_by_suffix(files: DataFrame, most: int = 3) -> DataFrame:
    """suffix, dir, n: directories by their last one to ``most`` parts; of several the first, and how many there are.

    A file without a path is in no directory.
    """
    dirs = files.select(P.dir_of(F.col("path")).alias("dir")).where("dir is not null").distinct().withColumn("p", F.split("dir", "/"))
    each = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(most))), lambda k: F.array_join(F.slice("p", -k, k), "/"))).alias("suffix"))
    return each.groupBy("suffix").agg(F.min("dir").alias("dir"), F.count(F.lit(1)).alias("n"))
