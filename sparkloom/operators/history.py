"""Churn, ownership, co-change, hotspots and activity from commits (commit, author, day, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import spread, stage

#: Commits of more files say nothing about coupling.
MAX_FILES = 50


def churn(commits: DataFrame) -> DataFrame:
    """path, churn, authors, solo, first_seen, last_touched; days compare as text."""
    out = commits.groupBy("path").agg(F.count(F.lit(1)).alias("churn"), F.countDistinct("author").alias("authors"), F.min("day").alias("first_seen"), F.max("day").alias("last_touched"))
    return out.withColumn("solo", F.col("authors") == 1)


def hotspots(churned: DataFrame, complexity: DataFrame) -> DataFrame:
    """Live files only, with hotspot: churn and complexity, each over its maximum."""
    live = stage(churned.join(complexity.select("path", F.greatest("complexity", F.lit(1)).alias("complexity")), "path"), "hotspots")
    top = live.agg(F.greatest(F.max("churn"), F.lit(1)).alias("c"), F.greatest(F.max("complexity"), F.lit(1)).alias("x"))
    score = F.floor(100 * (F.col("churn") / F.col("c")) * (F.col("complexity") / F.col("x")) + 0.5).cast("long")
    return live.join(F.broadcast(top)).withColumn("hotspot", score).drop("c", "x")


def authors(commits: DataFrame) -> DataFrame:
    """author, commits, first_day, last_day, files."""
    return commits.groupBy("author").agg(F.countDistinct("commit").alias("commits"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("path").alias("files"))


def pairs(commits: DataFrame) -> DataFrame:
    """a, b of all files changed together, once a commit; commits of 2 to MAX_FILES files.

    Commits are counted first, so lists are only gathered for those that have a bounded one.
    """
    return _pairs(commits)[0]


def _pairs(commits: DataFrame) -> tuple[DataFrame, int]:
    """The pairs, and how many they are at most."""
    commits = stage(commits.select("commit", "path"), "pairs-commits")
    # dealt once: counts and lists stay in their task, and a window keeps the rows of a large commit on disk
    dealt = spread(commits, commits.count(), "commit").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("commit")))
    lists = stage(dealt.where(F.col("n").between(2, MAX_FILES)).groupBy("commit").agg(F.array_sort(F.collect_set("path")).alias("p")), "pairs-lists")
    most = lists.agg(F.coalesce(F.sum(F.expr("size(p) * (size(p) - 1L) div 2")), F.lit(0)).alias("most")).first().most
    at = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select("commit", F.explode(at).alias("x")).select("commit", "x.a", "x.b"), most


def _counted(commits: DataFrame, *more: Column) -> DataFrame:
    """a, b, n and what else is asked of every pair: most pairs occur once, so they are dealt before they are counted."""
    found, most = _pairs(commits)
    return spread(found, most, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *more)


def cooccurring(commits: DataFrame, least: int = 2) -> DataFrame:
    """a, b, n of the pairs changed together so often."""
    return _counted(commits).where(F.col("n") >= least)


def cochange(commits: DataFrame, edges: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """The pairs changed together most often that don't import each other."""
    tied = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    free = pairs(commits).join(tied, ["a", "b"], "left_anti")
    return free.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(most)


def first_pairs(commits: DataFrame, most: int = 5000) -> DataFrame:
    """Counts of the pairs that were seen first: ranked by first commit, then a, b."""
    seen = _counted(commits, F.min("commit").alias("first"))
    return seen.orderBy("first", "a", "b").limit(most).where("n >= 2").select("a", "b", "n")


def punchcard(activity: DataFrame) -> DataFrame:
    """Day of the week (0 is Sunday) by hour; activity: ts."""
    return activity.groupBy((F.dayofweek("ts") - 1).alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def calendar(activity: DataFrame) -> DataFrame:
    """Every day between the first and the last with its count and level (0 to 4)."""
    days = stage(activity.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")), "calendar")
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.max("n").alias("top")).where("a is not null")
    grid = span.select("top", F.explode(F.sequence("a", "b")).alias("day"))
    out = grid.join(days, "day", "left").fillna(0, ["n"])
    return out.select("day", "n", F.least(F.lit(4), F.ceil(4.0 * F.col("n") / F.col("top"))).cast("long").alias("level"))


def trend(scans: DataFrame) -> DataFrame:
    """Change of score from scan to scan of every repository, zero for the first; scans: repo, at, score."""
    before = F.lag("score").over(Window.partitionBy("repo").orderBy("at"))
    out = scans.withColumn("change", F.coalesce(F.col("score") - before, F.lit(0).cast("long")))
    return out.withColumn("trend", F.when(F.col("change") > 0, "improving").when(F.col("change") < 0, "degrading").otherwise("stable"))
