"""Quality rules of documents and of their hosts (operator 6).

Every document is judged by its own counts first.  Failures are then added up by
host (``source``); a host's failure rate is shrunk towards the corpus by a beta
prior fitted by the moments of a beta-binomial: of the spread between hosts, what
binomial sampling alone would give is taken off, and hosts count by their size.  A
host whose shrunk rate is above ``HOST_LIMIT``, where a document more often fails
than not, fails with all its documents; a few bad documents of a small host don't
suffice.

Everything is DataFrame functions.  The counts come from arrays inside a row
(sorted windows, no window leaves its row), are written once, and the texts are
not moved: sums by host have partial sums in every task, and verdicts come back
by a join of counts with hosts, in which Spark can split a hot host.

Edge cases: null and empty texts have no words and fail; a null source is a host
of its own; with one host, or no spread beyond chance, all rates are the mean;
rows with one doc_id are judged one by one; extra columns are left out; no rows
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.shared import let, small, stage

MIN_WORDS = 50
#: Percent of words that may lie in repeated windows.
MAX_REPEATED = 50
WINDOW = 3
HOST_LIMIT = 0.5
BROADCAST_HOSTS = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def spaced(text: Column) -> Column:
    """The text with every blank (space, tab to carriage return) as a space."""
    for blank in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(spaced(text), " "), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more: windows are sorted, equal neighbours are repeats."""

    def of(w: Column) -> Column:
        last = F.size(w) - window
        key = lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(window)))
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(key(i).alias("k"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["k"].eqNullSafe(F.get(s, j)["k"])
            found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.array_sort(F.transform(found, lambda j: F.get(s, j)["i"]))

        def covered(p: Column) -> Column:
            gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(window)))
            return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(window), lambda n, g: n + g))

        return F.when(last < 1, F.lit(0)).otherwise(let(let(windows, places), covered))

    return let(words, of).cast("long")


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, the counts of every row and whether it fails by itself."""
    t = F.col("__t")
    spaces = F.length(t) - F.length(F.replace(spaced(t), F.lit(" "), F.lit("")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.replace(spaced(x), F.lit(" "), F.lit(""))) > 0)
    out = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__t")).select(
        *keep,
        let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("__w"),
        (F.length(t) - spaces).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = out.select(*keep, F.col("__w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__w.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(judged: DataFrame) -> DataFrame:
    """source, docs, failed, rate (shrunk) of every host; judged: source, base_failed."""
    hosts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("base_failed").alias("failed"))
    hosts = stage(hosts, "quality-hosts")
    n, bad = F.col("docs").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), F.sum(bad).alias("bad"), F.sum(bad * bad / n).alias("square"))
    prior = sums.select("*", (F.col("bad") / F.col("n")).alias("mean")).select("*", (F.col("mean") * (1 - F.col("mean"))).alias("room"))
    by_chance = (F.col("k") - 1) * F.col("room")
    spread = F.try_divide(F.col("square") - F.col("n") * F.col("mean") * F.col("mean") - by_chance, F.col("n") - F.col("n2") / F.col("n") - (F.col("k") - 1))
    known = (F.col("k") > 1) & (F.col("n") - F.col("n2") / F.col("n") > F.col("k") - 1) & (spread > 1e-9)
    strength = F.when(known, F.greatest(F.try_divide("room", spread) - 1, F.lit(0.0)))  # null: no spread beyond chance
    prior = prior.select("mean", strength.alias("strength"))
    rate = F.coalesce((F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength")), "mean")
    return hosts.join(F.broadcast(prior)).withColumn("rate", rate).select("source", "docs", "failed", "rate")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, source, counts, base_failed, host_rate and kept of every row."""
    judged = stage(base_counts(docs.select("doc_id", "source", "text"), "doc_id", "source"), "quality-counts")
    hosts = small(stage(host_rates(judged).select(F.col("source").alias("host"), F.col("rate").alias("host_rate")), "quality-rates"), BROADCAST_HOSTS)
    out = judged.join(hosts, F.col("source").eqNullSafe(F.col("host"))).drop("host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= HOST_LIMIT))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", F.round("host_rate", 9).alias("host_rate"), "kept")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM g),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM k),
rep AS (SELECT DISTINCT r, i + o AS i FROM m, (SELECT unnest(range(0, 3)) AS o) WHERE n > 1),
c AS (SELECT r, count(*) AS n FROM rep GROUP BY r),
b AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM f GROUP BY 1),
s AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS n2, sum(bad) / sum(n) AS mean, sum(bad::DOUBLE * bad / n) AS square FROM h),
q AS (SELECT mean, k, n - n2 / n AS room, mean * (1 - mean) AS v, (square - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - n2 / n - (k - 1)) AS spread FROM s),
p AS (SELECT mean, CASE WHEN k > 1 AND room > k - 1 AND spread > 1e-9 THEN greatest(v / spread - 1, 0.0) END AS strength FROM q),
v AS (SELECT source, coalesce((bad + mean * strength) / (n + strength), mean) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
