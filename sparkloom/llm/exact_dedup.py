"""Exact deduplication by a log-structured merge index of digests (operator 2).

* **Flush.** Every task of the scan is one memtable: it sorts the digests of its
  rows and writes them as one run.  No row is shuffled.
* **Compaction.** Runs are merged by digest into the smallest identifier and the
  number of members.  Partial sums in each task keep a hot digest at one row a task.
* **Levels.** An ``Index`` holds compacted tables by level; ``FAN_OUT`` tables of a
  level are merged into one of the next, so a row is rewritten once a level.  New
  runs look digests up behind each table's filter before any join.
* **Filter.** The digests with several members set bits of a bitmap of
  ``2 ** FILTER_BITS`` bits (8 MB at most, whatever the size of the corpus).
* **Byte verification.** Only rows that pass the filter show their bytes: they are
  grouped by digest *and* text, so a digest shared by different texts is seen and
  resolved by the texts themselves.

Everything is DataFrame functions; runs and indexes live in the shared folder.

Edge cases: a null text counts as empty; the smallest id is the smallest that is
not null, and of rows with that id the one with the smallest row number; so exactly
one row of a group stays, repeated rows and null ids included; extra columns are
left out of the result (and kept by ``keep_first``); an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.filters import bitmap_of, marked, without
from sparkloom.llm.shared import stage, unused

#: The filter has 2 ** 26 bits in pieces of 4 KB: at most 8 MB are broadcast.
FILTER_BITS = 26
#: Tables of a level that are merged into one of the next.
FAN_OUT = 4


def normalised(text: Column) -> Column:
    """Runs of blanks (space, tab to carriage return) as one space; null as empty."""
    t = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\f\r":
        t = F.replace(t, F.lit(blank), F.lit(" "))
    return F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed(docs: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """row, id, normalised text and digest of every row; row numbers hold within one scan unless ``row_col`` names them."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    t = docs.select(row.alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    return t.withColumn("digest", digest(F.col("body")))


def flush(rows: DataFrame) -> DataFrame:
    """One sorted run a task, with Parquet's own filters and bounds on the digest."""
    run = rows.select("digest", "id", "row").sortWithinPartitions("digest", "id")
    return stage(run, "dedup-runs", **{"parquet.bloom.filter.enabled#digest": "true"})


def _smallest(id_col: str, row_col: str) -> Column:
    """The smallest id that is not null, and of rows with it the smallest row."""
    return F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row_col).alias("row")))


def _members(level: DataFrame) -> DataFrame:
    if "members" in level.columns:
        return level
    return level.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("members"))


def compact(*levels: DataFrame) -> DataFrame:
    """Merges runs (digest, id, row) or indexes (digest, keep_id, keep_row, members) into one sorted index."""
    merged = _members(levels[0])
    for part in levels[1:]:
        merged = merged.unionByName(_members(part))
    index = merged.groupBy("digest").agg(_smallest("keep_id", "keep_row").alias("k"), F.sum("members").alias("members"))
    index = index.select("digest", F.col("k.id").alias("keep_id"), F.col("k.row").alias("keep_row"), "members")
    return stage(index.sortWithinPartitions("digest"), "dedup-index", **{"parquet.bloom.filter.enabled#digest": "true"})


class Index:
    """Compacted tables by level, for corpora that arrive in parts.

    Row numbers of different parts must not repeat (``row`` is any orderable key).
    """

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def add(self, runs: DataFrame) -> None:
        """Takes the runs of one part; full levels are compacted into the next."""
        table = compact(runs)
        for level in self.levels:
            level.append(table)
            if len(level) < FAN_OUT:
                return
            table = compact(*level)
            level.clear()
        self.levels.append([table])

    def lookup(self, runs: DataFrame) -> DataFrame:
        """digest, keep_id, keep_row, members of the runs' digests that the index has, all levels merged."""
        asked = runs.select("digest").distinct()
        found = None
        for table in (t for level in self.levels for t in level):
            maybe = marked(asked, "digest", bitmap_of(table, "digest", FILTER_BITS), FILTER_BITS).where("maybe").select("digest")
            part = table.join(maybe, "digest", "left_semi")
            found = part if found is None else found.unionByName(part)
        return compact(found if found is not None else asked.limit(0).selectExpr("digest", "cast(null as long) keep_id", "cast(null as long) keep_row", "0L members"))

    def merged(self) -> DataFrame:
        """The whole index as one table."""
        return compact(*(t for level in self.levels for t in level))


def hit_filter(index: DataFrame) -> DataFrame:
    """The bitmap of digests with several members."""
    return bitmap_of(index.where("members > 1"), "digest", FILTER_BITS)


def may_hit(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows whose digest may have several members; none of those is missed."""
    return marked(rows, "digest", bitmap, FILTER_BITS).where("maybe").drop("maybe")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, row_col: str | None = None) -> DataFrame:
    """id, row, digest, keep_id, group_size and kept of every row of ``docs``; exactly one row of a group is kept."""
    rows = keyed(docs, digest, id_col, text_col, row_col)
    runs = flush(rows)
    index = compact(runs)
    hits = may_hit(rows, hit_filter(index))
    texts = hits.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    clashes = stage(texts.groupBy("digest").count().where("count > 1").select("digest"), "dedup-clashes")
    known = index.where("members > 1").select("digest", "keep_id", "keep_row", F.col("members").alias("group_size"))
    out = ["id", "row", "digest", "keep_id", "keep_row", "group_size"]
    if clashes.isEmpty():
        found = runs.join(known, "digest", "left").select(out)
    else:  # different texts share a digest: those rows are settled by their texts
        disputed = stage(rows.join(clashes, "digest", "left_semi"), "dedup-disputed")
        settled = disputed.groupBy("digest", "body").agg(_smallest("id", "row").alias("k"), F.count(F.lit(1)).alias("group_size"))
        settled = settled.select("digest", "body", F.col("k.id").alias("keep_id"), F.col("k.row").alias("keep_row"), "group_size")
        found = (
            runs.join(clashes, "digest", "left_anti").join(known, "digest", "left").select(out)
            .unionByName(disputed.join(settled, ["digest", "body"]).select(out))
        )
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias(id_col), "row", "digest",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the document that stays for its text."""
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the smallest id stays, every other row goes.

    Decisions are by row, so texts that share an id are decided each by its own group.
    """
    columns, row = docs.columns, unused(docs, "__row")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-docs")
    dropped = exact_dedup(docs, row_col=row).where("not kept").select(F.col("row").alias(row))
    return without(docs, row, stage(dropped, "dedup-dropped"), FILTER_BITS).select(columns)


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
