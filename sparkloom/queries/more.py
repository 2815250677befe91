"""Further joins, rollups and views over the same bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom.functions import code as C
from sparkloom.functions import paths as P
from sparkloom.operators import folders as D
from sparkloom.operators import graph as G
from sparkloom.operators import symbols as S
from sparkloom.operators.findings import grade
from sparkloom.plans import views as V
from sparkloom.queries import files as Q
from sparkloom.queries import graphs as H
from sparkloom.sources import repository
from sparkloom.storage import spread, stage


def join_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose two ends are parts of size 10 or more."""
    big = B.nodes(spark, sf).where("complexity >= 10")
    return G.within(big, B.edges(spark, sf))


def join_dir_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier imports a package (a brand) and so every part in it."""
    imports = B.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("package"))
    files = B.table(spark, sf, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"))
    return S.package_targets(imports, files)


def join_name_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first path of every base name."""
    return B.table(spark, sf, "part").groupBy("p_name").agg(F.min(F.concat_ws("/", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).alias("first_path"))


def join_deadexport_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Exports (suppliers of a part) that nobody imports by name (in a return)."""
    li = B.table(spark, sf, "lineitem")
    exports = li.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").cast("string").alias("name")).distinct()
    used = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("path"), F.when(F.col("l_quantity") == 50, "*").otherwise(F.col("l_suppkey").cast("string")).alias("name"))
    spared = B.nodes(spark, sf).where("is_entry or is_test").select(F.col("node").alias("path"))
    return S.dead_exports(exports, used, spared)


def join_symbol_claim(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that match as text but are not shown as headings already."""
    lines = B.files(spark, sf).select("path", F.posexplode(F.split("text", "\n")).alias("at", "l"))
    hits = lines.where(F.contains(F.lower("l"), F.lit("the "))).select("path", "at")
    claimed = lines.where(F.col("l").rlike("^The ")).select("path", "at")
    return hits.join(claimed, ["path", "at"], "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def join_layer_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between the 60 most imported nodes."""
    nodes, edges = B.nodes(spark, sf), stage(B.edges(spark, sf), "edges")
    shown = G.degrees(nodes, edges).orderBy(F.desc("fan_in"), "node").limit(60)
    return G.within(shown, edges)


def agg_folder_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """What one folder imports from and is imported by, by the other folder."""
    e = V.folder_edges(B.nodes(spark, sf), B.edges(spark, sf))
    out = e.where("src_folder = 'Brand#5'").select(F.lit("out").alias("way"), F.col("dst_folder").alias("other"), "n")
    return out.unionByName(e.where("dst_folder = 'Brand#5'").select(F.lit("in").alias("way"), F.col("src_folder").alias("other"), "n"))


def agg_tech_debt(spark: SparkSession, sf: str) -> DataFrame:
    """Share of files that are hard to maintain, and its class."""
    t, lang = F.col("text"), F.col("lang")
    files = B.files(spark, sf)
    f = spread(files, files.count(), "doc_id").select(C.halstead(t, lang).alias("h"), C.complexity(t, lang).alias("cx"), C.code_stats(t, lang).alias("s"))
    mi = F.round(C.maintainability(F.col("h.volume"), F.col("cx"), F.col("s.code")), 4)
    out = f.agg(F.count_if(mi < 65).alias("low"), F.count(F.lit(1)).alias("files"))
    ratio = F.col("low") / F.greatest("files", F.lit(1))
    return out.withColumn("debt", F.when(ratio > 0.5, "critical").when(ratio > 0.25, "high").when(ratio > 0.1, "moderate").otherwise("low"))


def agg_entry_reach(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(B.nodes(spark, sf), B.edges(spark, sf)).where("is_entry").select("node", F.col("fan_out").alias("reaches"))


def agg_folder_files(spark: SparkSession, sf: str) -> DataFrame:
    return B.files(spark, sf).groupBy(P.dir_of(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


def win_line_number(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every file's last occurrence of ``and``, counted by the breaks before it."""
    t = F.col("text")
    tail = F.length(F.substring_index(t, "and", -1))
    head = F.left(t, F.length(t) - tail - 3)
    return B.files(spark, sf).where(F.contains(t, F.lit("and"))).select("path", (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line"))


def uniq_by(spark: SparkSession, sf: str) -> DataFrame:
    """The first order of every customer and status."""
    first = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    return B.table(spark, sf, "orders").withColumn("k", F.row_number().over(first)).where("k = 1").select("o_custkey", "o_orderstatus", "o_orderkey")


def atlas_filter(spark: SparkSession, sf: str) -> DataFrame:
    cards = V.atlas(G.degrees(B.nodes(spark, sf), B.edges(spark, sf)))
    return cards.where(F.contains(F.lower("title"), F.lit("1")) & (F.col("kind") == "folder"))


def top_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The five most complex and the five longest files."""
    f = stage(B.files(spark, sf).select("path", C.complexity(F.col("text"), F.col("lang")).alias("cx"), F.length("text").cast("long").alias("size")), "stats")
    pick = lambda c: f.orderBy(F.desc(c), "path").limit(5).select(F.lit(c).alias("by_"), "path", F.col(c).alias("value"))
    return pick("cx").unionByName(pick("size"))


def v_explain_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence a folder."""
    r = D.rollup(B.files(spark, sf))
    return r.select("dir", F.format_string("%s holds %d files with %d lines of code in %s.", "dir", "files", "loc", "langs").alias("text"))


def v_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """What a scan leaves out, by reason."""
    f = B.files(spark, sf)
    reason = P.skip_reason(F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("node_modules/"), F.col("path"))).otherwise(F.col("path")), F.length("text"), 5000)
    return repository.counters(f.select(reason.alias("reason"))).where("reason <> 'parsed'")


def v_security_grades(spark: SparkSession, sf: str) -> DataFrame:
    """A grade for every customer's orders by their share of urgent ones: the grading scale over a table."""
    o = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))
    score = F.floor(100.0 - 100.0 * F.col("urgent") / F.col("n")).cast("long")
    return o.select("o_custkey", score.alias("score"), grade(score, (90, 75, 60, 45)).alias("grade"))


def agg_cluster_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Members of communities by brand, the three most frequent sizes each."""
    edges = B.edges(spark, sf).withColumn("repo", (F.col("src") % 16).cast("string")).select("repo", "src", "dst")
    c = G.communities(edges).join(B.nodes(spark, sf).select("node", "folder"), "node")
    tally = c.groupBy("repo", "community", "folder").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("repo", "community").orderBy(F.desc("n"), "folder")
    return tally.withColumn("k", F.row_number().over(top)).where("k <= 3").drop("k")


def scan_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A fingerprint of the files of every language."""
    return B.files(spark, sf).select("path", "lang", F.length("text").alias("size")).groupBy("lang").agg(repository.cache_key())


def sink_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A Markdown table of folders as lines in order."""
    r = D.rollup(B.files(spark, sf))
    return r.select("dir", F.concat(F.lit("| "), "dir", F.lit(" | "), F.col("files").cast("string"), F.lit(" | "), F.col("loc").cast("string"), F.lit(" |")).alias("line")).orderBy("dir")


QUERIES = {f.__name__: f for f in (
    join_degree, join_dir_fanout, join_name_first, join_deadexport_anti, join_symbol_claim, join_layer_edges, agg_folder_crossings, agg_tech_debt, agg_entry_reach,
    agg_folder_files, win_line_number, uniq_by, atlas_filter, top_stats, v_explain_folder, v_lineage, v_security_grades, agg_cluster_tally, scan_cache, sink_docs,
)}

_E30 = "WITH " + B.edges_sql() + "," + B.NODES
_FE = _E30 + ", fe AS (SELECT a.folder AS s, b.folder AS d, count(*) AS n FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.folder <> b.folder GROUP BY 1, 2)"
ORACLES = {
    "scan_cache": "WITH " + B.FILES + "SELECT lang, count(*) || '-' || sum(('0x' || substr(sha256(path || chr(31) || length(text)), 1, 12))::BIGINT)::VARCHAR AS key FROM files GROUP BY 1",
    "join_degree": _E30 + "SELECT src, dst FROM edges WHERE src IN (SELECT node FROM nodes WHERE complexity >= 10) AND dst IN (SELECT node FROM nodes WHERE complexity >= 10)",
    "join_dir_fanout": "SELECT DISTINCT 's' || s_suppkey AS src, p_brand || '/' || p_partkey AS dst FROM supplier JOIN part ON p_brand = 'Brand#' || (s_suppkey % 25 + 1)",
    "join_name_first": "SELECT p_name, min(p_brand || '/' || lpad(p_partkey::VARCHAR, 8, '0')) AS first_path FROM part GROUP BY 1",
    "join_deadexport_anti": """WITH x AS (SELECT DISTINCT l_partkey AS path, l_suppkey::VARCHAR AS name FROM lineitem), u AS (SELECT DISTINCT l_partkey AS path, CASE WHEN l_quantity = 50 THEN '*' ELSE l_suppkey::VARCHAR END AS name FROM lineitem WHERE l_returnflag = 'R')
        SELECT path, name FROM x WHERE path % 97 <> 0 AND path % 10 <> 0 AND path NOT IN (SELECT path FROM u WHERE name = '*') AND (path, name) NOT IN (SELECT (path, name) FROM u)""",
    "join_symbol_claim": "WITH " + B.FILES + ", l AS (SELECT path, unnest(string_split(text, chr(10))) AS l FROM files) SELECT path, count(*) AS n FROM l WHERE contains(lower(l), 'the ') AND NOT starts_with(l, 'The ') GROUP BY 1",
    "join_layer_edges": _E30 + "," + H._FACTS + ", s AS (SELECT node FROM facts ORDER BY fan_in DESC, node LIMIT 60) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s)",
    "agg_folder_crossings": _FE + "SELECT 'out' AS way, d AS other, n FROM fe WHERE s = 'Brand#5' UNION ALL SELECT 'in', s, n FROM fe WHERE d = 'Brand#5'",
    "agg_tech_debt": Q._W + "," + Q._CLEAN + "," + Q._HAL + "," + Q._STATS + f""", m AS (SELECT round(CASE WHEN volume = 0 OR code = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, (171 - 5.2 * ln(volume) - 0.23 * {Q._CX} - 16.2 * ln(code::DOUBLE)) * 100 / 171)) END, 4) AS mi FROM h JOIN stats USING (path)),
        c AS (SELECT count(*) FILTER (mi < 65) AS low, count(*) AS files FROM m) SELECT *, CASE WHEN low / files > 0.5 THEN 'critical' WHEN low / files > 0.25 THEN 'high' WHEN low / files > 0.1 THEN 'moderate' ELSE 'low' END AS debt FROM c""",
    "agg_entry_reach": _E30 + "," + H._FACTS + "SELECT node, fan_out AS reaches FROM facts WHERE is_entry",
    "agg_folder_files": "WITH " + B.FILES + "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS files, min(path) AS first FROM files GROUP BY 1",
    "win_line_number": "WITH " + B.FILES + "SELECT path, len(string_split(left(text, length(text) - strpos(reverse(text), 'dna') - 2), chr(10)))::BIGINT AS line FROM files WHERE contains(text, 'and')",
    "uniq_by": "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1",
    "atlas_filter": "SELECT 'folder' AS kind, p_brand AS title, count(*) AS n FROM part WHERE contains(p_brand, '1') GROUP BY 2",
    "top_stats": Q._W + "," + Q._CLEAN + f", s AS (SELECT path, {Q._CX} AS cx, length(text)::BIGINT AS size FROM clean) SELECT * FROM (SELECT 'cx' AS by_, path, cx AS value FROM s ORDER BY cx DESC, path LIMIT 5) UNION ALL SELECT * FROM (SELECT 'size', path, size FROM s ORDER BY size DESC, path LIMIT 5)",
    "v_explain_folder": Q._W + "," + Q._STATS + r"""SELECT dir, dir || ' holds ' || n || ' files with ' || loc || ' lines of code in ' || langs || '.' AS text FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n, sum(code)::BIGINT AS loc, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM files JOIN stats USING (path) GROUP BY 1)""",
    "v_lineage": Q._W + "SELECT * FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'vendorDir' WHEN length(text) > 5000 THEN 'tooLarge' END AS reason, count(*) AS n FROM files GROUP BY 1) WHERE reason IS NOT NULL",
    "v_security_grades": "WITH s AS (SELECT o_custkey, floor(100.0 - 100.0 * count(*) FILTER (starts_with(o_orderpriority, '1')) / count(*))::BIGINT AS score FROM orders GROUP BY 1) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade FROM s",
    "sink_docs": Q._W + "," + Q._STATS + r"""SELECT dir, '| ' || dir || ' | ' || n || ' | ' || loc || ' |' AS line FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n, sum(code)::BIGINT AS loc FROM files JOIN stats USING (path) GROUP BY 1)""",
}
