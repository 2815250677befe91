"""Files of one or many repositories as rows, with a reason for every file that is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import paths as P


def read(spark: SparkSession, root: str, max_size: int = 200 * 1024, ignore: str = "") -> DataFrame:
    """path, text, lang, size, reason of every file below ``root``; reason is null for files to be analysed.

    Texts of files that are left out are not decoded; files of no bytes are not seen by Spark's file sources.  ``ignore`` holds the lines of a .gitignore file.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.element_at(F.split("path", F.lit(base.removeprefix("file://") + "/"), 2), -1)
    rows = raw.select(path.alias("path"), "length", "content")
    reason = P.skip_reason(F.col("path"), F.col("length"), max_size)
    rules = ignore_pattern(ignore)
    if rules:
        reason = F.when(F.col("path").rlike(rules), "ignored").otherwise(reason)
    binary = F.hex(F.substring("content", 1, 1000)).rlike("^(?:..)*?00")  # a zero byte, not two halves of others
    rows = rows.withColumn("reason", F.when(reason.isNull() & binary, "binary").otherwise(reason))
    return rows.select("path", F.when(F.col("reason").isNull(), F.decode("content", "UTF-8")).alias("text"), P.language_of(F.col("path")).alias("lang"), F.col("length").alias("size"), "reason")


def ignore_pattern(text: str) -> str:
    """One pattern for the lines of a .gitignore file; negations are left out, nested files are not read."""
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule[0] in "#!":
            continue
        anchored, folder = rule.startswith("/"), rule.endswith("/")
        body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, _quoted(p)) for p in _pieces(rule.strip("/")))
        out.append(("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)"))
    return "|".join(f"({x})" for x in out)


def _pieces(rule: str) -> list[str]:
    out, k = [], 0
    while k < len(rule):
        n = 2 if rule.startswith("**", k) else 1
        out.append(rule[k : k + n])
        k += n
    return out


def _quoted(c: str) -> str:
    return "\\" + c if c in ".+^$(){}|[]\\" else c


def counters(files: DataFrame) -> DataFrame:
    """reason, n; files to be analysed count as parsed."""
    return files.groupBy(F.coalesce("reason", F.lit("parsed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def truncated(files: DataFrame, most: int) -> DataFrame:
    """The first files by depth and path."""
    return files.orderBy(P.depth_of(F.col("path")), "path").limit(most)


def truncation(files: DataFrame, most: int) -> DataFrame:
    """at_files, files_left, dirs_left: what a walk by depth and path that stops after ``most`` files leaves out; no row if it ends before."""
    total = files.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    shown = truncated(files, most).agg(F.max(F.struct(P.depth_of(F.col("path")), "path")).alias("last"))
    beyond = F.struct(P.depth_of(F.col("path")), F.col("path")) > F.col("last")
    left = files.join(F.broadcast(shown)).where(beyond).agg(F.count(F.lit(1)).alias("files_left"), F.countDistinct(P.dir_of(F.col("path"))).alias("dirs_left"))
    return total.join(F.broadcast(left)).select(F.lit(most).cast("long").alias("at_files"), "files_left", "dirs_left")


def cache_key() -> Column:
    """An aggregate: a fingerprint of files (path, size) in which order does not matter and every repeated row counts."""
    parts = F.sha2(F.concat_ws("\x1f", "path", F.col("size").cast("string")), 256)
    low = F.conv(F.substring(parts, 1, 12), 16, 10).cast("decimal(38,0)")
    return F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum(low).cast("string")).alias("key")
