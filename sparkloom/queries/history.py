"""Commits, activity and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom.operators import deps as D
from sparkloom.operators import history as H


def _complexity(spark: SparkSession, sf: str) -> DataFrame:
    """Of the parts that still exist: those of odd number or size over 10."""
    return B.nodes(spark, sf).where("node % 2 = 1 or complexity > 10").select(F.col("node").alias("path"), "complexity")


def _hot(spark: SparkSession, sf: str) -> DataFrame:
    return H.hotspots(H.churn(B.commits(spark, sf)), _complexity(spark, sf))


def agg_churn(spark: SparkSession, sf: str) -> DataFrame:
    return H.churn(B.commits(spark, sf))


def agg_solo(spark: SparkSession, sf: str) -> DataFrame:
    return H.churn(B.commits(spark, sf)).agg(F.count_if(F.expr("solo and churn >= 3")).alias("solo_files"), F.count(F.lit(1)).alias("files"))


def agg_authors(spark: SparkSession, sf: str) -> DataFrame:
    return H.authors(B.commits(spark, sf))


def agg_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most active authors with their share."""
    a = H.authors(B.commits(spark, sf))
    total = a.agg(F.sum("commits").alias("total"))
    return a.join(F.broadcast(total)).select("author", "commits", "first_day", "last_day", F.round(100.0 * F.col("commits") / F.col("total"), 4).alias("percent")).orderBy(F.desc("commits"), "author").limit(10)


def agg_hotspot(spark: SparkSession, sf: str) -> DataFrame:
    return _hot(spark, sf).select("path", "churn", "complexity", "hotspot")


def top_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return _hot(spark, sf).select("path", "churn", "hotspot").orderBy(F.desc("hotspot"), F.desc("churn"), "path").limit(25)


def join_history_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Live files, and those that only the history knows."""
    churned, live = H.churn(B.commits(spark, sf)).select("path"), _complexity(spark, sf).select("path", F.lit(1).alias("x"))
    return churned.join(live, "path", "left").agg(F.count("x").alias("live"), F.count_if(F.col("x").isNull()).alias("gone"))


def join_cooccur(spark: SparkSession, sf: str) -> DataFrame:
    return H.cooccurring(B.commits(spark, sf))


def agg_cochange(spark: SparkSession, sf: str) -> DataFrame:
    return H.cochange(B.commits(spark, sf), B.edges(spark, sf))


def win_first_seen_cap(spark: SparkSession, sf: str) -> DataFrame:
    return H.first_pairs(B.commits(spark, sf))


def agg_punchcard(spark: SparkSession, sf: str) -> DataFrame:
    return H.punchcard(B.table(spark, sf, "events"))


def agg_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return H.calendar(B.table(spark, sf, "events")).withColumn("day", F.col("day").cast("string"))


def agg_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer is a repository, every order a scan."""
    o = B.table(spark, sf, "orders")
    return H.trend(o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("at"), F.floor("o_totalprice").cast("long").alias("score")))


def win_first_match(spark: SparkSession, sf: str) -> DataFrame:
    """The first commit of every file with its author."""
    first = Window.partitionBy("path").orderBy("day", "commit")
    return B.commits(spark, sf).withColumn("k", F.row_number().over(first)).where("k = 1").select("path", "commit", "author")


def agg_externals(spark: SparkSession, sf: str) -> DataFrame:
    return D.externals(B.imported(spark, sf))


def _builtin(spark: SparkSession, sf: str) -> DataFrame:
    return B.nodes(spark, sf).where("node % 100 = 0").select(F.col("node").alias("name"))


def join_drift_anti(spark: SparkSession, sf: str) -> DataFrame:
    declared, imported = B.declared(spark, sf), B.imported(spark, sf)
    lost, extra = D.unused(declared, imported), D.undeclared(declared, imported, _builtin(spark, sf))
    return lost.withColumn("drift", F.lit("unused")).unionByName(extra.withColumn("drift", F.lit("undeclared")))


def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return B.declared(spark, sf).select("name").union(B.imported(spark, sf).select("name")).distinct()


def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return B.declared(spark, sf).select("name").intersect(B.imported(spark, sf).select("name"))


def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return B.declared(spark, sf).select("name").subtract(B.imported(spark, sf).select("name"))


def licence_sbom(spark: SparkSession, sf: str) -> DataFrame:
    return D.bill_of_materials(_named(spark, sf)).select("name", "label", "version", "ecosystem", "dev", "licence", "kind")


def _named(spark: SparkSession, sf: str) -> DataFrame:
    known = list(D.KNOWN)
    d = B.declared(spark, sf)
    return d.withColumn("label", F.when(F.col("name") % 3 == 0, F.element_at(F.array(*map(F.lit, known)), (F.col("name") % len(known) + 1).cast("int"))).otherwise(F.col("label")))


def agg_licence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.licence_counts(D.bill_of_materials(_named(spark, sf)))


def sbom_filter(spark: SparkSession, sf: str) -> DataFrame:
    bom = D.bill_of_materials(_named(spark, sf))
    return bom.where(~F.col("dev") & (F.contains("label", F.lit("re")) | F.contains(F.lower("licence"), F.lit("bsd")))).select("name", "label", "licence")


def top_stack(spark: SparkSession, sf: str) -> DataFrame:
    return D.stack(_named(spark, sf))


def hourly_activity(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's hours, in batch."""
    e = B.table(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).withColumn("hour", F.col("hour").cast("string"))


QUERIES = {f.__name__: f for f in (
    agg_churn, agg_solo, agg_authors, agg_leaderboard, agg_hotspot, top_hotspots, join_history_scan, join_cooccur, agg_cochange, win_first_seen_cap, agg_punchcard, agg_calendar,
    agg_trend, win_first_match, agg_externals, join_drift_anti, set_union, set_intersect, set_except, licence_sbom, agg_licence_counts, sbom_filter, top_stack, hourly_activity,
)}

_C = "WITH " + B.COMMITS
_CHURN = ", churn AS (SELECT path, count(*) AS churn, count(DISTINCT author) AS authors, min(day) AS first_seen, max(day) AS last_touched, count(DISTINCT author) = 1 AS solo FROM commits GROUP BY 1)"
_LIVE = ", live AS (SELECT p_partkey AS path, greatest(p_size, 1)::BIGINT AS complexity FROM part WHERE p_partkey % 2 = 1 OR p_size > 10)"
_HOT = _CHURN + _LIVE + ", j AS (SELECT * FROM churn JOIN live USING (path)), hot AS (SELECT *, floor(100 * (churn / (SELECT max(churn) FROM j)) * (complexity / (SELECT max(complexity) FROM j)) + 0.5)::BIGINT AS hotspot FROM j)"
_AUTHORS = ', authors AS (SELECT author, count(DISTINCT "commit") AS commits, min(day) AS first_day, max(day) AS last_day, count(DISTINCT path) AS files FROM commits GROUP BY 1)'
_PAIRS = ', ok AS (SELECT "commit" FROM commits GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), pairs AS (SELECT a."commit", a.path AS a, b.path AS b FROM commits a JOIN commits b ON a."commit" = b."commit" AND a.path < b.path WHERE a."commit" IN (SELECT "commit" FROM ok))'
_DI = "WITH " + B.DECLARED + ", " + B.IMPORTED
_KNOWN = "[" + ", ".join(f"'{k}'" for k in D.KNOWN) + "]"
_LICENCE = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.KNOWN.items()) + " ELSE 'Permissive (Inferred)' END"
_BOM = "WITH " + B.DECLARED + f", named AS (SELECT * REPLACE (CASE WHEN name % 3 = 0 THEN {_KNOWN}[name % {len(D.KNOWN)} + 1] ELSE label END AS label) FROM declared), bom AS (SELECT name, label, replace(split_part(version, ' ', 1), '^', '') AS version, ecosystem, dev, {_LICENCE} AS licence FROM named), bill AS (SELECT *, CASE WHEN regexp_matches(upper(licence), 'MIT|APACHE|BSD') THEN 'permissive' ELSE 'custom' END AS kind FROM bom)"
ORACLES = {
    "agg_churn": _C + _CHURN + "SELECT * FROM churn",
    "agg_solo": _C + _CHURN + "SELECT count(*) FILTER (solo AND churn >= 3) AS solo_files, count(*) AS files FROM churn",
    "agg_authors": _C + _AUTHORS + "SELECT * FROM authors",
    "agg_leaderboard": _C + _AUTHORS + "SELECT author, commits, first_day, last_day, round(100.0 * commits / (SELECT sum(commits) FROM authors), 4) AS percent FROM authors ORDER BY commits DESC, author LIMIT 10",
    "agg_hotspot": _C + _HOT + "SELECT path, churn, complexity, hotspot FROM hot",
    "top_hotspots": _C + _HOT + "SELECT path, churn, hotspot FROM hot ORDER BY hotspot DESC, churn DESC, path LIMIT 25",
    "join_history_scan": _C + _CHURN + _LIVE + "SELECT count(live.path) AS live, count(*) - count(live.path) AS gone FROM churn LEFT JOIN live USING (path)",
    "join_cooccur": _C + _PAIRS + "SELECT a, b, count(*) AS n FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2",
    "agg_cochange": _C + _PAIRS + "," + B.edges_sql() + "SELECT a, b, count(*) AS n FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.src = p.a AND e.dst = p.b) OR (e.src = p.b AND e.dst = p.a)) GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 20",
    "win_first_seen_cap": _C + _PAIRS + ', f AS (SELECT a, b, min("commit") AS first, count(*) AS n FROM pairs GROUP BY 1, 2 ORDER BY first, a, b LIMIT 5000) SELECT a, b, n FROM f WHERE n >= 2',
    "agg_punchcard": "SELECT dayofweek(ts)::INTEGER AS day, hour(ts)::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1, 2",
    "agg_calendar": "WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), g AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d) SELECT g.day::VARCHAR AS day, coalesce(n, 0) AS n, least(4, ceil(4.0 * coalesce(n, 0) / (SELECT max(n) FROM d)))::BIGINT AS level FROM g LEFT JOIN d USING (day)",
    "agg_trend": "WITH s AS (SELECT o_custkey AS repo, o_orderkey AS at_, floor(o_totalprice)::BIGINT AS score FROM orders), l AS (SELECT *, coalesce(score - lag(score) OVER (PARTITION BY repo ORDER BY at_), 0) AS change FROM s) SELECT repo, at_ AS at, score, change, CASE WHEN change > 0 THEN 'improving' WHEN change < 0 THEN 'degrading' ELSE 'stable' END AS trend FROM l",
    "win_first_match": _C + 'SELECT path, "commit", author FROM commits QUALIFY row_number() OVER (PARTITION BY path ORDER BY day, "commit") = 1',
    "agg_externals": "WITH " + B.IMPORTED + "SELECT name, count(DISTINCT src) AS users FROM imported GROUP BY 1",
    "join_drift_anti": _DI + "SELECT DISTINCT name, 'unused' AS drift FROM declared WHERE name NOT IN (SELECT name FROM imported) UNION ALL SELECT DISTINCT name, 'undeclared' FROM imported WHERE name NOT IN (SELECT name FROM declared) AND name NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 100 = 0)",
    "set_union": _DI + "SELECT name FROM declared UNION SELECT name FROM imported",
    "set_intersect": _DI + "SELECT name FROM declared INTERSECT SELECT name FROM imported",
    "set_except": _DI + "SELECT name FROM declared EXCEPT SELECT name FROM imported",
    "licence_sbom": _BOM + "SELECT name, label, version, ecosystem, dev, licence, kind FROM bill",
    "agg_licence_counts": _BOM + "SELECT count(*) FILTER (kind = 'permissive') AS permissive, 0::BIGINT AS copyleft, 0::BIGINT AS weak, count(*) AS total, count(*) FILTER (kind <> 'permissive') AS unknown, 'clean' AS status FROM bill",
    "sbom_filter": _BOM + "SELECT name, label, licence FROM bill WHERE NOT dev AND (contains(label, 're') OR contains(lower(licence), 'bsd'))",
    "top_stack": _BOM + "SELECT label, min(ecosystem) AS ecosystem FROM bill GROUP BY 1 ORDER BY list_position(['npm', 'pip', 'go', 'cargo'], min(ecosystem)), label LIMIT 48",
    "hourly_activity": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
