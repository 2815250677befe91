"""Mixing sources to target weights by Poisson replication (operator 5).

A document of source s appears k times, k drawn from a Poisson distribution whose
mean is the source's target repetition rate: target share times the corpus size,
over the source's own size.  The draw inverts the distribution at a uniform
number hashed from seed and doc_id, so it depends on nothing else: a task that is
run again draws the same.  A rate above ``PART_RATE`` is drawn in equal parts, each
with its own number, whose sum has the same distribution: tables stay short.  Copies are exploded and dealt out by a hash of
(seed, doc_id, copy), each partition sorted by it: a global shuffle.

Sizes are summed per source with partial sums, so a source with a third of all
rows costs one row a task; the documents themselves move once, in the shuffle,
where every copy has its own key.

Edge cases: a null source is a source of its own; a null text has size zero; a
source without characters, or without a weight when weights are given, has rate
zero; rows with one doc_id (a null is hashed as the word ``null``) draw the same
number; input columns named like an added one are replaced; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.shared import let, small, stage

SEED = 17
#: Without given weights a source's share is its size to this power, normalised.
TEMPERATURE = 0.7
#: Most sources that are broadcast (about 50 bytes a number of their tables); beyond, a join.
BROADCAST_SOURCES = 10_000


#: Rates above this are drawn in parts of at most this rate.
PART_RATE = 64.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts joined by colons."""
    joined = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities far into the tail, from sums of logarithms."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    step = lambda acc, k: F.struct(
        (acc["log"] + F.ln(rate) - F.ln(k.cast("double"))).alias("log"),
        F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + F.exp(acc["log"] + F.ln(rate) - F.ln(k.cast("double"))))).alias("all"),
    )
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def part_count(rate: Column) -> Column:
    return F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("int")


def draws(table: Column, parts: Column, seed: int, doc_id: Column) -> Column:
    """The number of copies: for every part how many cumulative probabilities lie at or below its uniform number."""

    def one(k: Column) -> Column:
        own = F.when(k == 0, uniform(F.lit(seed), doc_id)).otherwise(uniform(F.lit(seed), doc_id, F.lit("part"), k))
        return let(own, lambda x: F.size(F.filter(table, lambda c: c <= x)))

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, k: n + one(k))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """source, size (characters), weight (share of the target) and rate of every source."""
    size = F.sum(F.length(F.coalesce("text", F.lit(""))).cast("long"))
    sizes = stage(docs.groupBy("source").agg(size.alias("size")), "mixing-sizes")
    if weights is None:
        sizes = sizes.withColumn("raw", F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = sizes.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, raw double")
        sizes = sizes.alias("a").join(given.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "size", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    total = sizes.agg(F.sum("raw").alias("all_raw"), F.sum("size").alias("all_size"))
    share = F.when(F.col("all_raw") > 0, F.col("raw") / F.col("all_raw")).otherwise(0.0)
    rate = F.when(F.col("size") > 0, F.col("weight") * F.col("all_size") / F.col("size")).otherwise(0.0)
    return sizes.join(F.broadcast(total)).withColumn("weight", share).withColumn("rate", rate).select("source", "size", "weight", "rate")


def replicate(docs: DataFrame, weights: Mapping[str | None, float] | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: the columns of ``docs``, replica (from 0) and shuffle_key, in shuffled order."""
    docs = docs.drop("replica", "shuffle_key")
    table = rates(docs, weights).where("rate > 0").select(F.col("source").alias("__source"), part_count(F.col("rate")).alias("__parts"), "rate")
    table = table.select("__source", "__parts", poisson_table(F.col("rate") / F.col("__parts")).alias("__table"))
    table = small(stage(table, "mixing-rates"), BROADCAST_SOURCES)
    copies = draws(F.col("__table"), F.col("__parts"), seed, F.col("doc_id"))
    drawn = docs.join(table, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__copies", copies).drop("__source", "__table", "__parts").where("__copies > 0")
    out = drawn.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    parts = [F.coalesce(p.cast("string"), F.lit("null")) for p in (F.lit(seed), F.col("doc_id"), F.col("replica"))]
    out = out.withColumn("shuffle_key", F.substring(F.md5(F.concat_ws(":", *parts)), 1, 16))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents at the default temperature."""
    return replicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as drawn, in shuffled order."""
    return replicate(docs).select(docs.columns)


MIX_SQL = """
sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM {docs} GROUP BY 1),
rates AS (SELECT source, CASE WHEN size > 0 THEN pow(size::DOUBLE, 0.7) / sum(pow(size::DOUBLE, 0.7)) OVER () * sum(size) OVER () / size ELSE 0 END AS rate FROM sizes),
parts AS (SELECT source, greatest(ceil(rate / 64), 1)::BIGINT AS m, rate / greatest(ceil(rate / 64), 1) AS rate FROM rates WHERE rate > 0),
steps AS (SELECT source, m, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM parts),
logs AS (SELECT source, m, k, -rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k::DOUBLE) END) OVER (PARTITION BY source ORDER BY k) AS lp FROM steps),
cdf AS (SELECT source, m, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS c FROM logs),
tables AS (SELECT source, m, list(c) AS t FROM cdf GROUP BY 1, 2),
hashed AS (SELECT d.*, t, list_transform(range(m), lambda j: ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || CASE WHEN j = 0 THEN '' ELSE ':part:' || j END), 1, 13))::BIGINT / 4503599627370496.0) AS u
  FROM {docs} d JOIN tables s ON d.source IS NOT DISTINCT FROM s.source),
drawn AS (SELECT * EXCLUDE (t, u), list_sum(list_transform(u, lambda x: len(list_filter(t, lambda c: c <= x))))::BIGINT AS copies FROM hashed)
"""

OP5_SQL = (
    "WITH "
    + MIX_SQL.format(docs="documents")
    + """
SELECT doc_id, text, lang, source, n_chars, replica::INTEGER AS replica,
       substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || replica::VARCHAR), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(0, copies)) AS replica FROM drawn WHERE copies > 0)
"""
)
