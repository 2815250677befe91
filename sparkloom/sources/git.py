"""Commit logs, diffs and blame as tables; state is carried from line to line by windows within one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Marks of an exported log: before a record and between its fields.  Fixed values.
RECORD, FIELD = "\x1e", "\x1f"
#: Columns of a commit.
COMMIT = "repo string, hash string, author string, email string, day string, files array<string>"


def _commit(record: Column, repo: Column) -> list[Column]:
    lines = F.split(record, "\n")
    fields = F.split(F.get(lines, F.lit(0)), FIELD)
    field = lambda k: F.coalesce(F.trim(F.get(fields, F.lit(k))), F.lit(""))
    files = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return [repo.alias("repo"), field(0).alias("hash"), field(1).alias("author"), field(2).alias("email"), field(3).alias("day"), files.alias("files")]


def read_log(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Commits of exported logs, a file a repository (its name without ending), as a table or a stream.

    Files are read record by record and split between tasks within one file, so a log of
    any length is never one row.  As a stream, files that arrive later are read then.
    """
    reader = (spark.readStream if stream else spark.read).format("text").option("lineSep", RECORD)
    raw = reader.load(folder).select("value", F.col("_metadata.file_name").alias("file"))
    rows = raw.where(F.trim(F.regexp_replace("value", r"\s", "")) != "").select(*_commit(F.col("value"), F.regexp_replace("file", r"\.[^.]*$", "")))
    return rows.where("hash <> '' and day <> ''")  # a record has all its fields: messages in place of a log have none


def log_states(spark: SparkSession, folder: str) -> DataFrame:
    """repo, commits, reason of every exported log; reason tells why there is no history, else it is null.

    Spark's file sources do not see files of no bytes: export the message of the tool instead.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("repo"), "length", F.decode(F.substring("content", 1, 200), "UTF-8").alias("head"))
    found = read_log(spark, folder).groupBy("repo").agg(F.count(F.lit(1)).alias("commits"))
    reason = (
        F.when(F.col("commits").isNotNull(), F.lit(None)).when((F.col("length") == 0) | F.col("head").rlike("(?i)does not have any commits"), "no commits")
        .when(F.col("head").rlike("(?i)not a git repository"), "no checkout").when(F.col("head").rlike("(?i)ENOENT|command not found"), "no git").otherwise("not a log")
    )
    return files.join(found, "repo", "left").select("repo", F.coalesce("commits", F.lit(0)).cast("long").alias("commits"), reason.alias("reason"))


def newest(commits: DataFrame, most: int = 2000) -> DataFrame:
    """The ``most`` newest commits of every repository (the length of a history view)."""
    order = Window.partitionBy("repo").orderBy(F.desc("day"), "hash")
    return commits.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def parse_log(logs: DataFrame) -> DataFrame:
    """repo, ord, hash, author, name, day, files from ``text`` with \\x1e before records and \\x1f between fields.

    The last field is followed by a line a file.
    """
    rec = logs.select("repo", F.posexplode(F.filter(F.split("text", "\x1e"), lambda r: F.trim(r) != "")).alias("ord", "r"))
    fields = rec.select("repo", "ord", F.split("r", "\x1f").alias("f"))
    tail = F.split(F.element_at("f", -1), "\n")
    name = F.col("f")
    files = F.filter(F.transform(F.slice(tail, 2, F.greatest(F.size(tail) - 1, F.lit(0))), F.trim), lambda x: x != "")
    return fields.where(F.size("f") >= 4).select("repo", "ord", F.trim(name[0]).alias("hash"), name[1].alias("author"), name[2].alias("name"), F.trim(tail[0]).alias("day"), files.alias("files"))


def parse_diff(diffs: DataFrame) -> DataFrame:
    """repo, file_no, old, new, hunk_no, line_no, kind (ctx, add, del), text of every line inside a hunk.

    State is carried within one text only: file numbers and line numbers are those of its own text.
    """
    lines = diffs.withColumn("id", F.monotonically_increasing_id()).select("repo", "id", F.posexplode(F.split("text", "\n")).alias("no", "l"))
    order = Window.partitionBy("repo", "id").orderBy("no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("is_file", F.col("l").startswith("diff --git ")).withColumn("is_hunk", F.col("l").rlike("^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@"))
    lines = lines.withColumn("file_no", F.sum(F.col("is_file").cast("int")).over(so_far))
    in_file = Window.partitionBy("repo", "id", "file_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("hunk_no", F.sum(F.col("is_hunk").cast("int")).over(in_file))
    carried = lambda rx, g: F.last(F.when(F.col("l").rlike(rx), F.regexp_extract("l", rx, g)), ignorenulls=True).over(in_file)
    head = r"^diff --git a/(.*) b/(.*)$"
    lines = lines.withColumn("old", carried(head, 1)).withColumn("new", carried(head, 2))
    first = F.left("l", F.lit(1))
    kind = F.when((first == "+") & ~F.col("l").startswith("+++"), "add").when((first == "-") & ~F.col("l").startswith("---"), "del").when(first == " ", "ctx")
    body = lines.where((F.col("hunk_no") > 0) & ~F.col("is_hunk")).withColumn("kind", kind).where("kind is not null")
    return body.select("repo", "file_no", "old", "new", "hunk_no", F.col("no").alias("line_no"), "kind", F.substring("l", F.lit(2), F.length("l")).alias("text"))


def diff_files(diffs: DataFrame) -> DataFrame:
    """repo, file_no, old, new, status (added, deleted, renamed, modified), additions, deletions, hunks of every file of a diff.

    Files without hunks are told too; the last header line about a status decides.
    """
    lines = diffs.withColumn("id", F.monotonically_increasing_id()).select("repo", "id", F.posexplode(F.split("text", "\n")).alias("no", "l"))
    so_far = Window.partitionBy("repo", "id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("file_no", F.sum(F.col("l").startswith("diff --git ").cast("int")).over(so_far)).where("file_no > 0")
    in_file = Window.partitionBy("repo", "id", "file_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("hunk_no", F.sum(F.col("l").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@").cast("int")).over(in_file))
    line, body = F.col("l"), F.col("hunk_no") > 0
    status = F.when(line.startswith("new file mode "), "added").when(line.startswith("deleted file mode "), "deleted").when(line.startswith("rename from "), "renamed")
    head = r"^diff --git a/(.+?) b/(.+)$"
    told = lambda value, rx, g: F.max(F.when(value.rlike(rx), F.trim(F.regexp_extract(value, rx, g))))
    out = lines.groupBy("repo", "id", "file_no").agg(
        F.coalesce(told(line, r"^rename from (.*)$", 1), told(line, head, 1)).alias("old"), F.coalesce(told(line, r"^rename to (.*)$", 1), told(line, head, 2)).alias("new"),
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), F.col("no"))), F.lit("modified")).alias("status"),
        F.count_if(body & line.startswith("+") & ~line.startswith("+++")).alias("additions"), F.count_if(body & line.startswith("-") & ~line.startswith("---")).alias("deletions"), F.max("hunk_no").alias("hunks"),
    )
    return out.drop("id")


def diff_stats(diff: DataFrame) -> DataFrame:
    """repo, file_no, new, additions, deletions, hunks."""
    return diff.groupBy("repo", "file_no", "new").agg(F.count_if(F.col("kind") == "add").alias("additions"), F.count_if(F.col("kind") == "del").alias("deletions"), F.countDistinct("hunk_no").alias("hunks"))


def parse_blame(blames: DataFrame) -> DataFrame:
    """repo, line_no, sha, author, day, text from porcelain text; a commit's facts are told once a text and reused."""
    lines = blames.withColumn("id", F.monotonically_increasing_id()).select("repo", "id", F.posexplode(F.split("text", "\n")).alias("no", "l"))
    so_far = Window.partitionBy("repo", "id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    own = lambda rx, g: F.last(F.when(F.col("l").rlike(rx), F.regexp_extract("l", rx, g)), ignorenulls=True).over(so_far)
    lines = lines.withColumn("sha", own(head, 1)).withColumn("line_no", own(head, 2).cast("int"))
    told = lambda key: F.max(F.when(F.col("l").startswith(key + " "), F.substring("l", F.lit(len(key) + 2), F.length("l")))).alias(key.replace("-", "_"))
    facts = lines.where("sha is not null").groupBy("repo", "id", "sha").agg(told("author"), told("author-time"))
    code = lines.where(F.col("l").startswith("\t")).select("repo", "id", "sha", "line_no", F.substring("l", F.lit(2), F.length("l")).alias("text"))
    return code.join(facts, ["repo", "id", "sha"]).select("repo", "line_no", "sha", "author", F.from_unixtime(F.col("author_time").cast("long"), "yyyy-MM-dd").alias("day"), "text")


def blame_authors(blame: DataFrame, shas: int = 10) -> DataFrame:
    """Lines, first and last day and the latest commits (sha, newest first) of every author."""
    commits = blame.groupBy("repo", "author", "sha").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("day"), F.min("day").alias("first"))
    newest = Window.partitionBy("repo", "author").orderBy(F.desc("day"), "sha")
    ranked = commits.withColumn("k", F.row_number().over(newest))
    latest = F.array_sort(F.collect_list(F.when(F.col("k") <= shas, F.struct("k", "sha"))))
    out = ranked.groupBy("repo", "author").agg(F.sum("n").alias("lines"), F.min("first").alias("oldest"), F.max("day").alias("newest"), latest.alias("l"))
    return out.select("repo", "author", "lines", "oldest", "newest", F.transform("l", lambda x: x["sha"]).alias("latest"))
