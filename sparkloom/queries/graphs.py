"""Import graphs: degrees, roles, reach, cycles, ranks, coupling, health and the views on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom.operators import graph as G
from sparkloom.plans import views as V
from sparkloom.storage import spread, stage


def _facts(spark: SparkSession, sf: str, least: int = 0) -> DataFrame:
    return G.degrees(B.nodes(spark, sf), B.edges(spark, sf, least))


def agg_fan(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select("node", "fan_in", "fan_out")


def top_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return G.hubs(_facts(spark, sf)).select("node", "fan_in", "fan_out").orderBy(F.desc("fan_in"), "node")


def g_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return G.orphans(_facts(spark, sf)).select("node")


def g_entries(spark: SparkSession, sf: str) -> DataFrame:
    return B.nodes(spark, sf).where("is_entry").select("node", "name")


def role_of(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select("node", G.role().alias("role"))


def g_instability(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select("node", F.round(G.instability(), 6).alias("instability"))


def agg_edge_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """One edge a pair with the union of its symbols; loops are dropped."""
    li = B.table(spark, sf, "lineitem")
    raw = li.select(F.col("l_partkey").alias("src"), (F.col("l_partkey") % 50 + F.col("l_suppkey") % 3).alias("dst"), F.col("l_returnflag").alias("symbol")).where("src <> dst")
    return raw.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))


def join_import_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Imports resolved to the first existing candidate path."""
    lines = B.table(spark, sf, "lineitem")
    # dealt by what is asked, once for both the distinct pairs and the join
    asked = lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("spec"), F.col("l_partkey").cast("string").alias("name"))
    li = spread(asked, lines.count(), "name").distinct()
    files = B.table(spark, sf, "part").where("p_size % 3 <> 0").select(F.concat(F.lit("lib/"), F.col("p_partkey").cast("string"), F.element_at(F.array(F.lit(".js"), F.lit(".ts"), F.lit("/index.js")), (F.col("p_size") % 3 + 1).cast("int"))).alias("path"))
    return V.resolve(li, F.col("name"), files, ("", ".js", ".ts", "/index.js")).drop("name")


def agg_import_tally(spark: SparkSession, sf: str) -> DataFrame:
    done = join_import_resolve(spark, sf)
    return done.agg(F.count(F.lit(1)).alias("total"), F.count("path").alias("internal"), F.count_if(F.col("path").isNull()).alias("unresolved")).withColumn("confidence", F.when(F.col("total") == 0, 100).otherwise(F.floor(100.0 * F.col("internal") / F.col("total") + 0.5)).cast("long"))


def agg_unresolved_top(spark: SparkSession, sf: str) -> DataFrame:
    lost = join_import_resolve(spark, sf).where("path is null").groupBy("spec").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_src"))
    return lost.orderBy(F.desc("n"), "spec").limit(12)


def g_closure(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure(B.edges(spark, sf, B.SPARSE))


def g_scc(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(B.nodes(spark, sf), B.edges(spark, sf))


def top_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.cycles(B.nodes(spark, sf), B.edges(spark, sf)).orderBy(F.desc("size"), "component").limit(10)


def g_blast_all(spark: SparkSession, sf: str) -> DataFrame:
    return G.blast(B.nodes(spark, sf), B.edges(spark, sf, B.SPARSE))


def g_blast_one(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that depends on the most imported node, by distance."""
    edges = stage(B.edges(spark, sf), "edges")
    top = G.hubs(G.degrees(B.nodes(spark, sf), edges)).orderBy(F.desc("fan_in"), "node").limit(1)
    return G.reach(top.select(F.lit(1).alias("key"), "node"), G.turned(edges)).select("node", "depth")


def g_blast_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Dependents of all changed nodes (those of size 50), the changed ones left out."""
    changed = B.nodes(spark, sf).where("complexity = 50").select(F.lit(1).alias("key"), "node")
    return G.reach(changed, G.turned(stage(B.edges(spark, sf), "edges"))).where("depth > 0").select("node", "depth")


def g_test_reach(spark: SparkSession, sf: str) -> DataFrame:
    return V.tested(B.nodes(spark, sf), stage(B.edges(spark, sf), "edges"))


def agg_coverage(spark: SparkSession, sf: str) -> DataFrame:
    nodes = B.nodes(spark, sf)
    tested = V.tested(nodes, stage(B.edges(spark, sf), "edges")).agg(F.count(F.lit(1)).alias("tested"))
    total = nodes.where("not is_test").agg(F.count(F.lit(1)).alias("total"))
    return tested.crossJoin(total).withColumn("ratio", F.when(F.col("total") == 0, 100).otherwise(F.floor(100.0 * F.col("tested") / F.col("total") + 0.5)).cast("long"))


def join_untested_hubs(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = B.nodes(spark, sf), stage(B.edges(spark, sf), "edges")
    return G.hubs(G.degrees(nodes, edges)).where("not is_test").join(V.tested(nodes, edges), "node", "left_anti").select("node", "fan_in")


def g_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return G.pagerank(B.nodes(spark, sf), B.edges(spark, sf)).select("node", F.round("rank", 9).alias("rank"))


def win_global_norm(spark: SparkSession, sf: str) -> DataFrame:
    rank = stage(_facts(spark, sf).select("node", "fan_in"), "fan")
    top = rank.agg(F.greatest(F.max("fan_in"), F.lit(1)).alias("top"))
    return rank.join(F.broadcast(top)).select("node", F.round(F.col("fan_in") / F.col("top"), 6).alias("share"))


def g_layers(spark: SparkSession, sf: str) -> DataFrame:
    edges = stage(B.dag(spark, sf), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return G.layers(nodes, edges)


def g_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return G.betweenness(B.nodes(spark, sf), B.edges(spark, sf, B.SPARSE)).select("node", F.round("between", 9).alias("between"))


def g_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Every brand is a repository: communities inside each."""
    edges, nodes = B.edges(spark, sf), B.nodes(spark, sf).select("node", "folder")
    a, b = nodes.withColumnRenamed("node", "src"), nodes.select(F.col("node").alias("dst"), F.col("folder").alias("other"))
    return G.communities(edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("folder = other").select(F.col("folder").alias("repo"), "src", "dst"))


def g_dep_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of every entry down to depth 3."""
    start = B.nodes(spark, sf).where("is_entry").select(F.col("node").alias("key"), "node")
    return G.reach(start, stage(B.edges(spark, sf), "edges"), 3)


def g_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbours(B.edges(spark, sf))


def win_topk_group(spark: SparkSession, sf: str) -> DataFrame:
    top = Window.partitionBy("folder").orderBy(F.desc("fan_in"), "node")
    return _facts(spark, sf).withColumn("k", F.row_number().over(top)).where("k <= 3").select("folder", "node", "fan_in", "k")


def agg_folder_edges(spark: SparkSession, sf: str) -> DataFrame:
    return V.folder_edges(B.nodes(spark, sf), B.edges(spark, sf))


def agg_coupling_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return V.coupling(B.nodes(spark, sf), B.edges(spark, sf), 8)


def agg_folder_internal(spark: SparkSession, sf: str) -> DataFrame:
    return V.folder_traffic(B.nodes(spark, sf), B.edges(spark, sf))


def g_health(spark: SparkSession, sf: str) -> DataFrame:
    return V.health(B.nodes(spark, sf), B.edges(spark, sf))


def top_risk(spark: SparkSession, sf: str) -> DataFrame:
    return g_health(spark, sf).select("node", "risk").orderBy(F.desc("risk"), "node").limit(25)


def agg_health(spark: SparkSession, sf: str) -> DataFrame:
    return V.score(B.nodes(spark, sf), B.edges(spark, sf))


def v_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return V.patterns(_facts(spark, sf))


def v_tour(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = B.nodes(spark, sf), stage(B.edges(spark, sf), "edges")
    return V.tour(G.degrees(nodes, edges), G.cycles(nodes, edges))


def v_inspector(spark: SparkSession, sf: str) -> DataFrame:
    return V.inspector(_facts(spark, sf), B.edges(spark, sf))


def v_report(spark: SparkSession, sf: str) -> DataFrame:
    return V.report(_facts(spark, sf))


def v_diagram(spark: SparkSession, sf: str) -> DataFrame:
    return V.diagram(B.nodes(spark, sf), B.edges(spark, sf))


def v_atlas(spark: SparkSession, sf: str) -> DataFrame:
    return V.atlas(_facts(spark, sf))


def v_risks(spark: SparkSession, sf: str) -> DataFrame:
    return V.risks(_facts(spark, sf))


QUERIES = {f.__name__: f for f in (
    agg_fan, top_hubs, g_orphans, g_entries, role_of, g_instability, agg_edge_dedupe, join_import_resolve, agg_import_tally, agg_unresolved_top, g_closure, g_scc, top_cycles,
    g_blast_all, g_blast_one, g_blast_diff, g_test_reach, agg_coverage, join_untested_hubs, g_pagerank, win_global_norm, g_layers, g_betweenness, g_communities, g_dep_tree,
    g_neighbors, win_topk_group, agg_folder_edges, agg_coupling_matrix, agg_folder_internal, g_health, top_risk, agg_health, v_patterns, v_tour, v_inspector, v_report,
    v_diagram, v_atlas, v_risks,
)}

_FACTS = """
fi AS (SELECT dst AS node, count(*) AS n FROM edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes) GROUP BY 1),
fo AS (SELECT src AS node, count(*) AS n FROM edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes) GROUP BY 1),
facts AS (SELECT nodes.*, coalesce(fi.n, 0) AS fan_in, coalesce(fo.n, 0) AS fan_out FROM nodes LEFT JOIN fi USING (node) LEFT JOIN fo USING (node))
"""
_G = lambda least=0: "WITH RECURSIVE " + B.edges_sql(least) + "," + B.NODES + "," + _FACTS
_INST = "CASE WHEN fan_in + fan_out = 0 THEN 0.0 ELSE fan_out / (fan_in + fan_out) END"
_CLOSURE = ", clo AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM clo c JOIN edges e ON c.dst = e.src)"
_SCC = ", comp AS (SELECT n.node, coalesce(least(n.node, min(c.dst)), n.node) AS component FROM nodes n LEFT JOIN (SELECT a.src, a.dst FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src) c ON c.src = n.node GROUP BY n.node)"
_REACH = ", bfs AS (SELECT node, 0 AS depth FROM start UNION SELECT {to}, depth + 1 FROM bfs JOIN edges ON {frm} = node WHERE depth < {most}), found AS (SELECT node, min(depth)::INTEGER AS depth FROM bfs GROUP BY 1)"
_TESTED = """, tst AS (SELECT DISTINCT dst AS node FROM edges JOIN nodes s ON s.node = src AND s.is_test JOIN nodes d ON d.node = dst AND NOT d.is_test
        UNION SELECT dst FROM tst JOIN edges ON src = tst.node JOIN nodes d ON d.node = dst AND NOT d.is_test)"""
_RANK = """, deg AS (SELECT src, count(*) AS o FROM edges GROUP BY 1), ranks AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r, 0 AS i FROM nodes
        UNION ALL SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + coalesce(sum(x.s), 0), any_value(it.i) + 1
        FROM nodes n CROSS JOIN (SELECT max(i) AS i FROM ranks) it LEFT JOIN (SELECT e.dst, 0.85 * ranks.r / o AS s FROM ranks JOIN edges e ON e.src = ranks.node JOIN deg ON deg.src = e.src) x ON x.dst = n.node
        WHERE it.i < 24 GROUP BY n.node), rank_ AS (SELECT node, r FROM ranks WHERE i = 24)"""
_HEALTH = f""", cyc AS (SELECT DISTINCT node FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) > 1)),
health AS (SELECT node, greatest(0, least(100, floor(34 * (r / m) + 26 * least(greatest(complexity, 1) / 28, 1.0) + 20 * (node IN (SELECT node FROM cyc))::INTEGER + 12 * least(loc / 900, 1.0) + 8 * ({_INST}) + 0.5)))::BIGINT AS risk,
        floor((r / m) * 100 + 0.5)::DOUBLE / 100 AS centrality, floor(({_INST}) * 100 + 0.5)::DOUBLE / 100 AS instability, greatest(complexity, 1) AS complexity, loc, fan_in, fan_out, node IN (SELECT node FROM cyc) AS in_cycle
        FROM facts JOIN rank_ USING (node), (SELECT greatest(max(r), 1e-9) AS m FROM rank_))"""
_RESOLVE = """WITH imp AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS spec FROM lineitem),
fil AS (SELECT 'lib/' || p_partkey || ['.js', '.ts', '/index.js'][p_size % 3 + 1] AS path FROM part WHERE p_size % 3 <> 0),
done AS (SELECT src, spec, arg_min(f.path, k) AS path FROM (SELECT src, spec, unnest(['', '.js', '.ts', '/index.js']) AS x, unnest([0, 1, 2, 3]) AS k FROM imp) c LEFT JOIN fil f ON f.path = 'lib/' || spec || x GROUP BY 1, 2)
"""
ORACLES = {
    "agg_fan": _G() + "SELECT node, fan_in, fan_out FROM facts",
    "top_hubs": _G() + "SELECT node, fan_in, fan_out FROM facts WHERE fan_in >= 2",
    "g_orphans": _G() + "SELECT node FROM facts WHERE fan_in = 0 AND NOT is_entry AND NOT is_test",
    "g_entries": "WITH " + B.NODES + "SELECT node, name FROM nodes WHERE is_entry",
    "role_of": _G() + "SELECT node, CASE WHEN is_test THEN 'test' WHEN is_entry THEN 'entry' WHEN fan_in >= 5 THEN 'hub' WHEN fan_out = 0 AND fan_in > 0 THEN 'leaf' ELSE 'module' END AS role FROM facts",
    "g_instability": _G() + f"SELECT node, round({_INST}, 6) AS instability FROM facts",
    "agg_edge_dedupe": "SELECT src, dst, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM (SELECT l_partkey AS src, l_partkey % 50 + l_suppkey % 3 AS dst, l_returnflag AS symbol FROM lineitem) WHERE src <> dst GROUP BY 1, 2",
    "join_import_resolve": _RESOLVE + "SELECT * FROM done",
    "agg_import_tally": _RESOLVE + "SELECT count(*) AS total, count(path) AS internal, count(*) - count(path) AS unresolved, floor(100.0 * count(path) / count(*) + 0.5)::BIGINT AS confidence FROM done",
    "agg_unresolved_top": _RESOLVE + "SELECT spec, count(*) AS n, min(src) AS first_src FROM done WHERE path IS NULL GROUP BY 1 ORDER BY n DESC, spec LIMIT 12",
    "g_closure": _G(B.SPARSE) + _CLOSURE + "SELECT * FROM clo",
    "g_scc": _G() + _CLOSURE + _SCC + "SELECT node, component FROM comp",
    "top_cycles": _G() + _CLOSURE + _SCC + "SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) > 1 ORDER BY size DESC, component LIMIT 10",
    "g_blast_all": _G(B.SPARSE) + _CLOSURE + _SCC + "SELECT n.node, count(DISTINCT c.src) AS blast FROM comp n LEFT JOIN (SELECT c.src, c.dst FROM clo c JOIN comp a ON a.node = c.src JOIN comp b ON b.node = c.dst WHERE a.component <> b.component) c ON c.dst = n.node GROUP BY 1",
    "g_blast_one": _G() + ", start AS (SELECT node FROM facts WHERE fan_in >= 2 ORDER BY fan_in DESC, node LIMIT 1)" + _REACH.format(to="src", frm="dst", most=60) + "SELECT * FROM found",
    "g_blast_diff": _G() + ", start AS (SELECT node FROM nodes WHERE complexity = 50)" + _REACH.format(to="src", frm="dst", most=60) + "SELECT * FROM found WHERE depth > 0",
    "g_test_reach": _G() + _TESTED + "SELECT node FROM tst",
    "agg_coverage": _G() + _TESTED + "SELECT (SELECT count(*) FROM tst) AS tested, count(*) AS total, floor(100.0 * (SELECT count(*) FROM tst) / count(*) + 0.5)::BIGINT AS ratio FROM nodes WHERE NOT is_test",
    "join_untested_hubs": _G() + _TESTED + "SELECT node, fan_in FROM facts WHERE fan_in >= 2 AND NOT is_test AND node NOT IN (SELECT node FROM tst)",
    "g_pagerank": _G() + _RANK + "SELECT node, round(r, 9) AS rank FROM rank_",
    "win_global_norm": _G() + "SELECT node, round(fan_in / (SELECT greatest(max(fan_in), 1) FROM facts), 6) AS share FROM facts",
    "g_layers": "WITH RECURSIVE " + B.DAG + ", walk AS (SELECT src AS node, 0 AS d FROM edges UNION SELECT dst, d + 1 FROM walk JOIN edges ON src = node) SELECT node, max(d)::INTEGER AS layer FROM walk GROUP BY 1",
    "g_dep_tree": _G() + ", b AS (SELECT node AS key, node, 0 AS depth FROM nodes WHERE is_entry UNION SELECT key, dst, depth + 1 FROM b JOIN edges ON src = node WHERE depth < 3) SELECT key, node, min(depth)::INTEGER AS depth FROM b GROUP BY 1, 2",
    "g_neighbors": _G() + "SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY node, side ORDER BY other) AS k FROM (SELECT dst AS node, 'importer' AS side, src AS other FROM edges UNION ALL SELECT src, 'import', dst FROM edges)) WHERE k <= 8",
    "win_topk_group": _G() + "SELECT folder, node, fan_in, k::INTEGER AS k FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY fan_in DESC, node) AS k FROM facts) WHERE k <= 3",
    "agg_folder_edges": _G() + "SELECT a.folder AS src_folder, b.folder AS dst_folder, count(*) AS n FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.folder <> b.folder GROUP BY 1, 2",
    "agg_coupling_matrix": _G() + """, fe AS (SELECT a.folder AS src_folder, b.folder AS dst_folder, count(*) AS n FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.folder <> b.folder GROUP BY 1, 2),
        tot AS (SELECT folder, sum(n) AS n FROM (SELECT src_folder AS folder, n FROM fe UNION ALL SELECT dst_folder, n FROM fe) GROUP BY 1 ORDER BY n DESC, folder LIMIT 8)
        SELECT src_folder, dst_folder, n, (SELECT max(n) FROM fe WHERE src_folder IN (SELECT folder FROM tot) AND dst_folder IN (SELECT folder FROM tot)) AS most FROM fe WHERE src_folder IN (SELECT folder FROM tot) AND dst_folder IN (SELECT folder FROM tot)""",
    "agg_folder_internal": _G() + """, e2 AS (SELECT a.folder AS s, b.folder AS d FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst), x AS (SELECT s AS folder, s = d AS inner_, NOT s = d AS outward, false AS inward FROM e2 UNION ALL SELECT d, false, false, true FROM e2 WHERE s <> d)
        SELECT folder, count(*) FILTER (inner_) AS internal, count(*) FILTER (outward) AS outward, count(*) FILTER (inward) AS inward FROM x GROUP BY 1""",
    "g_health": _G() + _CLOSURE + _SCC + _RANK + _HEALTH + "SELECT * FROM health",
    "top_risk": _G() + _CLOSURE + _SCC + _RANK + _HEALTH + "SELECT node, risk FROM health ORDER BY risk DESC, node LIMIT 25",
    "agg_health": _G() + _CLOSURE + _SCC + _RANK + _HEALTH + """, t AS (SELECT count(*) FILTER (risk >= 70) AS crit, count(*) FILTER (risk >= 50 AND risk < 70) AS high, avg(complexity) AS cx, count(*) AS n FROM health),
        u AS (SELECT *, least(10, (SELECT count(*) FROM (SELECT component FROM comp GROUP BY 1 HAVING count(*) > 1))) AS cycles, (SELECT count(*) FROM facts WHERE fan_in = 0 AND NOT is_entry AND NOT is_test) AS orphans FROM t),
        v AS (SELECT *, floor(cycles * 4 + 0.5)::BIGINT AS d_cycles, floor(crit * 4 + high * 2 + 0.5)::BIGINT AS d_risk, floor(greatest(0, cx - 6) * 2 + 0.5)::BIGINT AS d_cx, floor(25.0 * orphans / n + 0.5)::BIGINT AS d_orphans FROM u)
        SELECT crit, high, cycles, orphans, d_cycles, d_risk, d_cx, d_orphans, s AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT *, greatest(0, 100 - d_cycles - d_risk - d_cx - d_orphans) AS s FROM v)""",
    "v_patterns": _G() + """SELECT 'hub-and-spoke' AS pattern, count(*) AS n, min(node) AS example FROM facts WHERE fan_in >= 5 HAVING count(*) > 0
        UNION ALL SELECT 'god-files', count(*), min(node) FROM facts WHERE fan_in + fan_out >= 12 HAVING count(*) > 0
        UNION ALL SELECT 'barrels', count(*), min(node) FROM facts WHERE fan_in >= 2 AND fan_out >= 2 AND complexity <= 5 HAVING count(*) > 0
        UNION ALL SELECT 'test-shadow', count(*), min(node) FROM facts WHERE is_test HAVING count(*) > 0
        UNION ALL SELECT 'orphans', count(*), min(node) FROM facts WHERE fan_in = 0 AND NOT is_entry AND NOT is_test HAVING count(*) > 0
        UNION ALL SELECT 'entries', count(*), min(node) FROM facts WHERE is_entry HAVING count(*) > 0""",
    "v_report": _G() + "SELECT node, to_json({'schemaVersion': 1, 'node': node, 'name': name, 'fan_in': fan_in, 'fan_out': fan_out, 'role': CASE WHEN is_test THEN 'test' WHEN is_entry THEN 'entry' WHEN fan_in >= 5 THEN 'hub' WHEN fan_out = 0 AND fan_in > 0 THEN 'leaf' ELSE 'module' END})::VARCHAR AS json FROM facts",
    "v_diagram": _G() + "SELECT count(*) AS n, '  ' || translate(a.folder, '# ', '__') || ' -->|' || count(*) || '| ' || translate(b.folder, '# ', '__') AS line FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.folder <> b.folder GROUP BY a.folder, b.folder",
    "v_tour": _G() + _CLOSURE + _SCC + """, c AS (SELECT * FROM (SELECT node, CASE row_number() OVER (ORDER BY fan_out DESC, node) WHEN 1 THEN 1 ELSE 5 END AS slot FROM facts WHERE is_entry ORDER BY fan_out DESC, node LIMIT 2)
        UNION ALL SELECT * FROM (SELECT node, 1 + row_number() OVER (ORDER BY fan_in DESC, node) FROM facts WHERE fan_in >= 2 ORDER BY fan_in DESC, node LIMIT 3)
        UNION ALL SELECT * FROM (SELECT node, 6 FROM facts WHERE fan_out = 0 AND fan_in >= 2 ORDER BY fan_in DESC, node LIMIT 1)
        UNION ALL SELECT * FROM (SELECT component, 7 FROM comp GROUP BY 1 HAVING count(*) > 1 ORDER BY count(*) DESC, component LIMIT 1)
        UNION ALL SELECT * FROM (SELECT node, 8 FROM facts WHERE fan_in = 0 AND NOT is_entry AND NOT is_test ORDER BY node LIMIT 1))
        SELECT node, min(slot)::INTEGER AS slot FROM c GROUP BY 1""",
    "v_inspector": _G() + """, n8 AS (SELECT node, side, string_agg(other::VARCHAR, ',' ORDER BY other) AS l FROM (SELECT *, row_number() OVER (PARTITION BY node, side ORDER BY other) AS k FROM (SELECT dst AS node, 'importer' AS side, src AS other FROM edges UNION ALL SELECT src, 'import', dst FROM edges)) WHERE k <= 12 GROUP BY 1, 2)
        SELECT f.node, f.complexity, f.loc, f.fan_in, f.fan_out, coalesce(a.l, '') AS importers, coalesce(b.l, '') AS imports FROM facts f LEFT JOIN n8 a ON a.node = f.node AND a.side = 'importer' LEFT JOIN n8 b ON b.node = f.node AND b.side = 'import'""",
    "v_atlas": _G() + """SELECT 'folder' AS kind, folder AS title, count(*) AS n FROM facts GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'file', node::VARCHAR, fan_in FROM facts ORDER BY fan_in DESC, node LIMIT 200)""",
    "v_risks": _G() + """SELECT * FROM (SELECT 'orphans' AS risk, count(*) AS n FROM facts WHERE fan_in = 0 AND NOT is_entry AND NOT is_test UNION ALL SELECT 'complex', count(*) FROM facts WHERE complexity >= 28
        UNION ALL SELECT 'large', count(*) FROM facts WHERE loc >= 900 UNION ALL SELECT 'hubs', count(*) FROM facts WHERE fan_in >= 5) WHERE n > 0""",
}
