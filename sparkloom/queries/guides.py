"""Workflows and services, typed targets, documentation, diagrams and payloads for agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom import code_tables as K
from sparkloom.functions import paths as P
from sparkloom.operators import deps as D
from sparkloom.operators import graph as G
from sparkloom.operators import search as S
from sparkloom.operators import symbols as Y
from sparkloom.plans import agent as A
from sparkloom.plans import diagrams as M
from sparkloom.plans import docs as T
from sparkloom.plans import reports as R
from sparkloom.plans import targets
from sparkloom.plans import views as V
from sparkloom.queries import code, graphs, history, more
from sparkloom.queries.graphs import _G
from sparkloom.sources import config
from sparkloom.storage import spread, stage

#: Workflow of a supplier: {k} its key, {n} its nation.
FLOW = """name: "Flow {k}" # of nation {n}
on:
  push:
    branches: [main]
  schedule:
    - cron: '{n} 0 * * *'
jobs:
  build:
    name: Build {n}
    runs-on: node-{n}
    steps:
    - uses: actions/checkout@v{n}
    - name: Step {k}
      run: |
        echo {k}
        - no step
  ship:
    needs: [build, 'check{n}']
    steps:
      - run: ship {k} # now
"""
#: Compose file of a supplier.
COMPOSE = """services:
  web{k}:
    build:
      context: ./gen/d{n}/
    ports: ["80{n}:80", {k}:9{n}/tcp]
    depends_on:
      db:
        condition: ok
      cache{k}:
  db:
    image: "postgres:{n}" # {k}
volumes:
  web{k}:
"""


def _texts(spark: SparkSession, sf: str, path: str, text: str) -> DataFrame:
    fill = lambda x: F.replace(F.replace(F.lit(x), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{n}"), F.col("s_nationkey").cast("string"))
    keys = B.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return spread(keys, keys.count(), "s_suppkey").select(fill(path).alias("path"), fill(text).alias("text"))


def v_workflows(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of all workflows."""
    jobs = config.workflows(_texts(spark, sf, ".github/workflows/w{k}.yml", FLOW))
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws("=", s["name"], F.replace(s["run"], F.lit("\n"), F.lit("/")))), ";")
    return jobs.select("file", "name", F.array_join("triggers", ",").alias("triggers"), "job", "job_name", "runs_on", F.array_join("needs", ",").alias("needs"), steps.alias("steps"))


def compose_services(spark: SparkSession, sf: str) -> DataFrame:
    found = config.services(_texts(spark, sf, "s{k}/compose.yml", COMPOSE))
    return found.select("file", "name", F.coalesce("image", F.lit("")).alias("image"), F.coalesce("build", F.lit("")).alias("build"), F.array_join("ports", ",").alias("ports"), F.array_join("depends", ",").alias("depends"))


def join_service_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Services whose folder holds code files."""
    folders = K.sources(spark, sf).select(P.dir_of(F.col("path")).alias("path"))
    return config.service_folders(config.services(_texts(spark, sf, "s{k}/compose.yml", COMPOSE)), folders).select("file", "name", "folder")


def v_diagram_services(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(config.services(_texts(spark, sf, "s{k}/compose.yml", COMPOSE)), "services")
    return M.services(found, config.service_folders(found, K.sources(spark, sf).select(P.dir_of(F.col("path")).alias("path"))))


def resolve_target(spark: SparkSession, sf: str) -> DataFrame:
    """What suppliers' keys, typed in eight ways, mean among code files."""
    k = F.col("s_suppkey").cast("string")
    typed = F.array(F.concat(F.lit("gen/d0/p"), k, F.lit(".js")), F.concat(F.lit("d"), k), F.concat(F.lit("P"), k, F.lit(".Py")), F.concat(F.lit("./d1/p"), k, F.lit(".go")), F.concat(F.lit("/p"), k, F.lit("1")), F.concat(F.lit("no"), k), F.concat(F.lit("gen/d"), k, F.lit("/")), F.lit("."))
    asked = B.table(spark, sf, "supplier").where("s_suppkey < 200").select(F.get(typed, (F.col("s_suppkey") % 8).cast("int")).alias("typed"))
    return targets.resolve_target(asked, K.sources(spark, sf))


def v_doc_row(spark: SparkSession, sf: str) -> DataFrame:
    return T.doc_rows(graphs._facts(spark, sf)).drop("functions")


def v_facts_line(spark: SparkSession, sf: str) -> DataFrame:
    """A line a part; parts of size 7 stand for cycles."""
    facts = graphs._facts(spark, sf)
    return T.facts_line(facts, B.nodes(spark, sf).where("complexity = 7").select("node"))


def v_file_doc(spark: SparkSession, sf: str) -> DataFrame:
    return T.file_doc(graphs._facts(spark, sf), B.edges(spark, sf))


def v_folder_doc(spark: SparkSession, sf: str) -> DataFrame:
    return T.folder_doc(graphs._facts(spark, sf))


def v_parse_folder_doc(spark: SparkSession, sf: str) -> DataFrame:
    """Documentation of folders written as text and read again: every part's line by its brand."""
    rows = B.table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit(" of "), "p_type", F.lit(":  "), F.col("p_size").cast("string")).alias("text")))).alias("files"))
    text = F.concat(F.lit("Sure.\n"), T.write_doc(F.concat(F.lit("All of\n "), F.col("p_brand")), F.col("files")), F.lit("\n\nDone."))
    read = rows.select("p_brand", T.parse_doc(text).alias("d"))
    return read.select("p_brand", F.col("d.brief").alias("brief"), F.explode("d.files").alias("f")).select("p_brand", "brief", "f.name", "f.text")


def v_diagram_calls(spark: SparkSession, sf: str) -> DataFrame:
    return M.calls(code.code_calls(spark, sf))


def v_diagram_layers(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(graphs.g_layers(spark, sf), "layers").join(B.nodes(spark, sf).select("node", F.col("name").alias("label")), "node")
    return M.layers(found, B.dag(spark, sf))


def v_agent_overview(spark: SparkSession, sf: str) -> DataFrame:
    return A.overview(stage(graphs._facts(spark, sf), "facts"), B.edges(spark, sf))


def v_agent_architecture(spark: SparkSession, sf: str) -> DataFrame:
    return A.architecture(graphs.g_layers(spark, sf), V.folder_edges(B.nodes(spark, sf), B.edges(spark, sf)), 1_500)


def v_agent_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return A.dependencies(D.bill_of_materials(B.declared(spark, sf)))


def v_agent_explain_file(spark: SparkSession, sf: str) -> DataFrame:
    return A.explain_file(graphs._facts(spark, sf), B.edges(spark, sf))


def v_agent_search(spark: SparkSession, sf: str) -> DataFrame:
    """An enforced search as a payload."""
    files, query = B.files(spark, sf).select("path", "text"), S.compiled(spark, "path:src1 ext:py is:test")
    return A.search(S.search(files, query, 40), S.search_total(files, query), 1_000)


def v_patterns_further(spark: SparkSession, sf: str) -> DataFrame:
    """The patterns that rest on other reports."""
    nodes, edges = B.nodes(spark, sf), stage(B.edges(spark, sf), "edges")
    comp = G.components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    services = config.services(_texts(spark, sf, "s{k}/compose.yml", COMPOSE))
    return V.further_patterns(
        G.degrees(nodes, edges), edges, comp, graphs.join_untested_hubs(spark, sf), more.join_deadexport_anti(spark, sf), history.join_drift_anti(spark, sf), history.agg_externals(spark, sf), services
    )


def v_symbol_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Public names of files by language and kind."""
    found = stage(Y.extract(K.sources(spark, sf)), "statements")
    lang = found.select("path", "lang").distinct()
    return Y.exports(found).join(lang, "path").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


def stack_items(spark: SparkSession, sf: str) -> DataFrame:
    """Declared packages with category and documentation; every third has a known name."""
    named = F.array(*map(F.lit, D.STACK))
    d = B.declared(spark, sf).where("name < 400")
    label = F.when(F.col("name") % 3 == 0, F.get(named, (F.col("name") % len(D.STACK)).cast("int"))).when(F.col("name") % 3 == 1, F.concat(F.lit("host.org/x/"), F.get(named, (F.col("name") % 7).cast("int")))).otherwise(F.replace("label", F.lit(" "), F.lit("_")))
    return D.stack_items(d.withColumn("label", label), 60)


def doc_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Which addresses may be fetched: pages, and documentation of packages named like them."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.npmjs.com/package/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("http://"), F.lit("https://docs.rs/"))).otherwise(F.col("url"))
    return B.table(spark, sf, "pages").select("page_id", D.doc_allowed(url).alias("allowed"))


def _paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as files of a repository, and its edges by path."""
    k = F.col("node")
    name = lambda a, z: F.concat(F.lit(a), k.cast("string"), F.lit(z))
    files = B.nodes(spark, sf).select("node", F.when(k % 97 == 0, name("d", "/README.md")).when(k % 10 == 0, name("tests/t", ".py")).when(k % 31 == 0, name("m", "/main.go")).otherwise(name("src/f", ".js")).alias("path"))
    a, b = files.select(F.col("node").alias("src"), F.col("path").alias("from")), files.select(F.col("node").alias("dst"), F.col("path").alias("to"))
    return files.select("path"), B.edges(spark, sf).join(a, "src").join(b, "dst").select(F.col("from").alias("src"), F.col("to").alias("dst"))


def v_first_pr(spark: SparkSession, sf: str) -> DataFrame:
    files, edges = _paths(spark, sf)
    return R.trail(files, stage(edges, "edges")).withColumn("place", F.col("place").cast("long"))


def v_first_tasks(spark: SparkSession, sf: str) -> DataFrame:
    files, edges = _paths(spark, sf)
    return R.first_tasks(files, edges).withColumn("place", F.col("place").cast("long"))


def sink_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """A first contribution as text."""
    files, edges = _paths(spark, sf)
    return R.first_contribution(files, stage(edges, "edges"))


def v_deps_view(spark: SparkSession, sf: str) -> DataFrame:
    return R.links_view(graphs._facts(spark, sf), B.edges(spark, sf))


def v_log(spark: SparkSession, sf: str) -> DataFrame:
    return R.log_view(B.commits(spark, sf)).withColumn("place", F.col("place").cast("long"))


def v_ai_facts(spark: SparkSession, sf: str) -> DataFrame:
    return R.overview_sheet(stage(graphs._facts(spark, sf), "facts"), V.folder_edges(B.nodes(spark, sf), B.edges(spark, sf)))


def v_ai_folder_facts(spark: SparkSession, sf: str) -> DataFrame:
    return R.folder_sheets(B.nodes(spark, sf), B.edges(spark, sf))


QUERIES = {f.__name__: f for f in (
    stack_items, doc_hosts, v_first_pr, v_first_tasks, sink_markdown, v_deps_view, v_log, v_ai_facts, v_ai_folder_facts,
    v_workflows, compose_services, join_service_folder, v_diagram_services, resolve_target, v_doc_row, v_facts_line, v_file_doc, v_folder_doc, v_parse_folder_doc, v_diagram_calls, v_diagram_layers,
    v_agent_overview, v_agent_architecture, v_agent_dependencies, v_agent_explain_file, v_agent_search, v_symbol_kinds, v_patterns_further,
)}

_K = "s_suppkey::VARCHAR"
_DIRS = f"dirs AS (SELECT DISTINCT 'gen/d' || (p_partkey // {K.FOLDER}) AS folder FROM part)"
_S = "services AS (SELECT 's' || s_suppkey || '/compose.yml' AS file, s_suppkey AS k, s_nationkey AS n FROM supplier)"
_DOC = "doc AS (SELECT *, CASE WHEN is_entry THEN 'entry' WHEN fan_in >= 5 THEN 'hub' ELSE 'module' END AS role FROM facts)"
_N = lambda n, what: f"{n} || ' {what}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"


def _packed(parts: str, budget: int) -> str:
    """Tables z and pk (key, items, left_out) of table ``parts`` (key, rank, item)."""
    return f"z AS (SELECT *, sum(length(item) + 1) OVER (PARTITION BY key ORDER BY rank) AS so_far FROM {parts}), pk AS (SELECT key, coalesce(string_agg(CASE WHEN so_far <= {budget} THEN item END, ',' ORDER BY rank), '') AS items, count(*) FILTER (so_far > {budget}) AS left_out FROM z GROUP BY 1)"


_LAYERS = "walk AS (SELECT src AS node, 0 AS d FROM edges UNION SELECT dst, d + 1 FROM walk JOIN edges ON src = node), lay AS (SELECT node, max(d)::INTEGER AS layer FROM walk GROUP BY 1)"
_Q = lambda x: "'" + x.replace("'", "''") + "'"
_KNOWN = "known(i, key, category, docs) AS (VALUES " + ", ".join(f"({i}, {_Q(k)}, {_Q(c)}, {_Q(u)})" for i, (k, (c, u)) in enumerate(D.STACK.items())) + ")"
_REG = "reg(r, ecosystem, a, z, lang) AS (VALUES " + ", ".join(f"({i}, {_Q(e)}, {_Q(a)}, {_Q(z)}, {_Q(g)})" for i, (e, (a, z, g)) in enumerate(D.REGISTRIES.items())) + ")"
_PATHS = "WITH " + B.edges_sql() + """, f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 97 = 0 THEN 'd' || p_partkey || '/README.md' WHEN p_partkey % 10 = 0 THEN 'tests/t' || p_partkey || '.py' WHEN p_partkey % 31 = 0 THEN 'm' || p_partkey || '/main.go' ELSE 'src/f' || p_partkey || '.js' END AS path FROM part),
    u AS (SELECT f.path, count(*) AS users FROM edges JOIN f ON f.k = dst WHERE src IN (SELECT k FROM f) GROUP BY 1)"""
_TRAIL = """, en AS (SELECT 1 AS part, row_number() OVER (ORDER BY path) AS rk, path, 'entry' AS role FROM f WHERE path LIKE '%/main.go' QUALIFY rk <= 8), hb AS (SELECT 2 AS part, row_number() OVER (ORDER BY users DESC, path) AS rk, path, 'hub' AS role FROM u WHERE path NOT LIKE '%.md' QUALIFY rk <= 6),
    ev AS (SELECT * FROM en UNION ALL SELECT * FROM hb WHERE path NOT IN (SELECT path FROM en) UNION ALL SELECT * FROM (SELECT 3, row_number() OVER (ORDER BY path) AS rk, path, 'test' FROM f WHERE path LIKE 'tests/%' QUALIFY rk <= 2) UNION ALL SELECT * FROM (SELECT 4, row_number() OVER (ORDER BY path) AS rk, path, 'guide' FROM f WHERE path LIKE '%.md' QUALIFY rk <= 2)),
    tr AS (SELECT row_number() OVER (ORDER BY part, rk) AS place, path, role FROM ev QUALIFY place <= 12)"""
_TASKS = """, ts AS (SELECT 1::BIGINT AS place, 'trace the most imported file' AS task, path, users || ' files import it' AS reason FROM u WHERE path NOT LIKE '%.md' ORDER BY users DESC, u.path LIMIT 1),
    t2 AS (SELECT 2::BIGINT AS place, 'write down what it runs on' AS task, (SELECT min(path) FROM f WHERE path LIKE '%/main.go') AS path, 'no manifest is to be found' AS reason), tk AS (SELECT * FROM ts UNION ALL SELECT * FROM t2)"""
ORACLES = {
    "stack_items": "WITH " + B.DECLARED + f""", {_KNOWN}, {_REG}, d AS (SELECT declared.*, CASE WHEN name % 3 = 0 THEN a.key WHEN name % 3 = 1 THEN 'host.org/x/' || b.key ELSE replace(label, ' ', '_') END AS lab FROM declared JOIN known a ON a.i = name % {len(D.STACK)} JOIN known b ON b.i = name % 7 WHERE name < 400),
        o AS (SELECT lab, r, dev, d.ecosystem, version, a, z, lang FROM d JOIN reg USING (ecosystem) WHERE lab <> 'react-dom' OR d.ecosystem <> 'npm' QUALIFY row_number() OVER (PARTITION BY lab ORDER BY r, dev, version) = 1),
        k AS (SELECT o.*, category, docs FROM o LEFT JOIN known ON key = CASE ecosystem WHEN 'go' THEN split_part(lab, '/', -1) WHEN 'cargo' THEN CASE WHEN lab IN (SELECT key FROM known) THEN lab ELSE replace(lab, '_', '-') END ELSE lab END),
        s AS (SELECT lab AS name, CASE WHEN ecosystem = 'npm' THEN split_part(regexp_replace(version, '^[~^>=< ]+', ''), ' ', 1) ELSE '' END AS version, coalesce(category, 'Library') AS category, lang, CASE WHEN docs IS NOT NULL AND ecosystem <> 'go' THEN docs ELSE a || lab || z END AS docs, dev FROM k)
        SELECT * FROM s ORDER BY list_position([{", ".join(_Q(c) for c in D.CATEGORIES)}], category), name LIMIT 60""",
    "doc_hosts": "SELECT page_id, page_id % 3 = 0 OR (page_id % 3 = 1 AND starts_with(url, 'http://')) AS allowed FROM pages",
    "v_first_pr": _PATHS + _TRAIL + " SELECT place, path, role FROM tr",
    "v_first_tasks": _PATHS + _TASKS + " SELECT place, task, path, reason FROM tk",
    "sink_markdown": _PATHS + _TRAIL + _TASKS + """ SELECT '# First contribution' || chr(10) || chr(10) || (SELECT count(*) || ' files, ' || count(*) FILTER (path NOT LIKE '%.md') || ' of source, ' || count(*) FILTER (path LIKE 'tests/%') || ' tests, ' || count(*) FILTER (path LIKE '%.md') || ' guides' FROM f)
        || chr(10) || chr(10) || '## Trail' || chr(10) || chr(10) || (SELECT string_agg('- ' || role || ': `' || path || '`', chr(10) ORDER BY place) FROM tr) || chr(10) || chr(10) || '## Tasks' || chr(10) || chr(10) || (SELECT string_agg(place || '. ' || task || ' (`' || path || '`): ' || reason, chr(10) ORDER BY place) FROM tk) || chr(10) AS text""",
    "v_deps_view": _G() + """, ne AS (SELECT *, row_number() OVER (PARTITION BY node, side ORDER BY other) AS k FROM (SELECT dst AS node, 'importer' AS side, src AS other FROM edges UNION ALL SELECT src, 'import', dst FROM edges)),
        n AS (SELECT node, string_agg(CASE WHEN side = 'import' THEN other::VARCHAR END, ', ' ORDER BY other) AS i, string_agg(CASE WHEN side = 'importer' THEN other::VARCHAR END, ', ' ORDER BY other) AS o FROM ne WHERE k <= 15 GROUP BY 1)
        SELECT node, name || ' (' || CASE WHEN is_test THEN 'test' WHEN is_entry THEN 'entry' WHEN fan_in >= 5 THEN 'hub' WHEN fan_out = 0 AND fan_in > 0 THEN 'leaf' ELSE 'module' END || ')' || chr(10) || 'imports ' || fan_out || ': ' || coalesce(i, 'none') || chr(10) || 'imported by ' || fan_in || ': ' || coalesce(o, 'none') AS text FROM facts LEFT JOIN n USING (node)""",
    "v_log": "WITH " + B.COMMITS + """, w AS (SELECT "commit", author, day, count(path) AS files FROM commits GROUP BY ALL) SELECT row_number() OVER (ORDER BY day DESC, "commit") AS place, "commit", author, day, files FROM w QUALIFY place <= 15""",
    "v_ai_facts": _G() + """, fe AS (SELECT a.folder AS f, b.folder AS t, count(*) AS n FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.folder <> b.folder GROUP BY 1, 2)
        SELECT 'Files by folder: ' || (SELECT string_agg(folder || ' ' || n, ', ' ORDER BY folder) FROM (SELECT folder, count(*) AS n FROM facts GROUP BY 1)) || chr(10) || 'Imports between folders: ' || coalesce((SELECT string_agg(f || ' to ' || t || ' ' || n, ', ' ORDER BY n DESC, f, t) FROM (SELECT * FROM fe ORDER BY n DESC, f, t LIMIT 20)), 'none')
        || chr(10) || 'Entries: ' || coalesce((SELECT string_agg(node::VARCHAR, ', ' ORDER BY node) FROM (SELECT node FROM facts WHERE is_entry ORDER BY node LIMIT 20)), 'none') || chr(10) || 'Most imported: ' || coalesce((SELECT string_agg(node || ' ' || fan_in, ', ' ORDER BY fan_in DESC, node) FROM (SELECT * FROM facts WHERE fan_in >= 2 ORDER BY fan_in DESC, node LIMIT 6)), 'none') AS sheet""",
    "v_ai_folder_facts": _G() + """, e2 AS (SELECT src, dst, a.folder AS f, b.folder AS t FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst), r AS (SELECT f AS folder, CASE WHEN f = t THEN 'inside' ELSE 'outward' END AS way, src, dst FROM e2 UNION ALL SELECT t, 'inward', src, dst FROM e2 WHERE f <> t),
        k AS (SELECT *, row_number() OVER (PARTITION BY folder, way ORDER BY src, dst) AS k FROM r), g AS (SELECT folder, string_agg(CASE WHEN way = 'inside' THEN src || ' to ' || dst END, '; ' ORDER BY k) AS i, string_agg(CASE WHEN way = 'outward' THEN src || ' to ' || dst END, '; ' ORDER BY k) AS o, string_agg(CASE WHEN way = 'inward' THEN src || ' to ' || dst END, '; ' ORDER BY k) AS w FROM k WHERE k <= 12 GROUP BY 1)
        SELECT folder, folder || ': ' || n || ' files' || chr(10) || 'inside: ' || coalesce(i, 'none') || chr(10) || 'outward: ' || coalesce(o, 'none') || chr(10) || 'inward: ' || coalesce(w, 'none') AS sheet FROM (SELECT folder, count(*) AS n FROM nodes GROUP BY 1) LEFT JOIN g USING (folder)""",
    "v_workflows": """WITH j AS (SELECT '.github/workflows/w' || s_suppkey || '.yml' AS file, 'Flow ' || s_suppkey AS name, 'push,schedule' AS triggers, s_suppkey AS k, s_nationkey AS n FROM supplier)
        SELECT file, name, triggers, 'build' AS job, 'Build ' || n AS job_name, 'node-' || n AS runs_on, '' AS needs, 'actions/checkout@v' || n || ';Step ' || k || '=echo ' || k || '/- no step' AS steps FROM j
        UNION ALL SELECT file, name, triggers, 'ship', 'ship', 'ubuntu-latest', 'build,check' || n, 'ship ' || k || '=ship ' || k FROM j""",
    "compose_services": f"WITH {_S} SELECT file, 'web' || k AS name, '' AS image, './gen/d' || n || '/' AS build, '80' || n || ':80,' || k || ':9' || n AS ports, 'cache' || k || ',db' AS depends FROM services UNION ALL SELECT file, 'db', 'postgres:' || n, '', '', '' FROM services",
    "join_service_folder": f"WITH {_S}, {_DIRS} SELECT file, 'web' || k AS name, folder FROM services JOIN dirs ON folder = 'gen/d' || n",
    "v_diagram_services": f"WITH {_S}, {_DIRS} SELECT file, 'flowchart LR' || chr(10) || '  svc0([\"web' || k || '\\n80' || n || ':80, ' || k || ':9' || n || '\"])' || chr(10) || '  svc1([\"db\\npostgres:' || n || '\"])' || CASE WHEN folder IS NULL THEN '' ELSE chr(10) || '  svc0 -.-> dir0[\"' || folder || '\"]' END AS text FROM services LEFT JOIN dirs ON folder = 'gen/d' || n",
    "resolve_target": f"""WITH t(i, ext) AS (VALUES {", ".join(f"({i}, '{t[0]}')" for i, t in enumerate(K.TEXTS))}), f AS (SELECT 'gen/d' || (p_partkey // {K.FOLDER}) || '/p' || p_partkey || '.' || ext AS path FROM part JOIN t ON i = p_partkey % 8), {_DIRS},
        a AS (SELECT DISTINCT s_suppkey AS k, s_suppkey % 8 AS w FROM supplier WHERE s_suppkey < 200), q AS (SELECT k, w, CASE w WHEN 0 THEN 'gen/d0/p' || k || '.js' WHEN 1 THEN 'd' || k WHEN 2 THEN 'P' || k || '.Py' WHEN 3 THEN './d1/p' || k || '.go' WHEN 4 THEN '/p' || k || '1' WHEN 5 THEN 'no' || k WHEN 6 THEN 'gen/d' || k || '/' ELSE '.' END AS typed FROM a),
        sure AS (SELECT typed, 'file' AS kind, path FROM q JOIN f ON w = 0 AND path = typed UNION ALL SELECT typed, 'folder', folder FROM q JOIN dirs ON w IN (1, 6) AND folder = CASE w WHEN 1 THEN 'gen/' || typed ELSE rtrim(typed, '/') END
          UNION ALL SELECT typed, 'file', path FROM q JOIN f ON w = 2 AND regexp_extract(path, '[^/]*$') = lower(typed) UNION ALL SELECT typed, 'file', path FROM q JOIN f ON w = 3 AND ends_with(path, '/' || typed[3:]) UNION ALL SELECT DISTINCT typed, 'folder', '' FROM q WHERE w = 7),
        rest AS (SELECT DISTINCT typed, lower(CASE WHEN starts_with(typed, './') THEN typed[3:] ELSE typed END) AS low FROM q WHERE typed NOT IN (SELECT typed FROM sure)),
        near AS (SELECT typed, path FROM rest JOIN f ON contains(path, low) QUALIFY row_number() OVER (PARTITION BY typed ORDER BY length(path), path) <= 8)
        SELECT * FROM sure UNION ALL SELECT typed, 'similar', path FROM near UNION ALL SELECT typed, 'none', NULL FROM rest WHERE typed NOT IN (SELECT typed FROM near)""",
    "v_doc_row": _G() + f", {_DOC} SELECT node, name, fan_in, fan_out, role FROM doc",
    "v_facts_line": _G() + f", {_DOC} SELECT node, concat_ws(' · ', CASE WHEN role = 'entry' THEN 'entry' END, CASE WHEN fan_in >= 5 THEN 'hub' END, CASE WHEN complexity = 7 THEN 'in a cycle' END, fan_in || ' in, ' || fan_out || ' out') AS line FROM doc",
    "v_file_doc": _G() + f""", {_DOC}, b AS (SELECT dst AS node, string_agg(src::VARCHAR, ', ' ORDER BY src) AS by_ FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM edges) WHERE k <= 2 GROUP BY 1)
        SELECT node, name || CASE WHEN role = 'entry' THEN ' is an entry point with ' || {_N("fan_out", "import")} WHEN fan_in >= 5 THEN ' carries ' || {_N("fan_in", "importer")} || ', such as ' || by_ WHEN fan_in = 0 AND fan_out = 0 THEN ' has no links' WHEN fan_out = 0 THEN ' is a leaf with ' || {_N("fan_in", "importer")}
          WHEN fan_in = 0 THEN ' has ' || {_N("fan_out", "import")} || ' and no importer' ELSE ' has ' || {_N("fan_out", "import")} || ' and ' || {_N("fan_in", "importer")} END || '.' AS text FROM doc LEFT JOIN b USING (node)""",
    "v_folder_doc": _G() + f", t AS (SELECT folder, name, fan_in FROM facts QUALIFY row_number() OVER (PARTITION BY folder ORDER BY fan_in DESC, node) = 1), g AS (SELECT folder, count(*) AS n, string_agg(CASE WHEN is_entry THEN name END, ', ' ORDER BY node) AS ways FROM facts GROUP BY 1) SELECT folder, concat_ws(' ', {_N('n', 'file')} || '.', CASE WHEN fan_in >= 3 THEN 'Most imported: ' || name || ' (' || fan_in || ').' END, 'Entries: ' || ways || '.') AS text FROM g JOIN t USING (folder)",
    "v_parse_folder_doc": "SELECT p_brand, 'All of ' || p_brand AS brief, p_name || '/' || p_partkey AS name, 'of ' || p_type || ': ' || p_size AS text FROM part",
    "v_diagram_calls": code.ORACLES["code_calls"].replace("SELECT path, 'load_' || k", ", c AS (SELECT path, 'load_' || k", 1) + """),
        n AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY name) - 1 AS i FROM (SELECT path, caller AS name FROM c UNION SELECT path, callee FROM c)), nd AS (SELECT path, string_agg('  n' || i || '["' || name || '()"]', chr(10) ORDER BY name) AS nodes FROM n GROUP BY 1),
        lk AS (SELECT DISTINCT c.path, c.caller, c.callee, '  n' || a.i || ' --> n' || b.i AS line FROM c JOIN n a ON a.path = c.path AND a.name = caller JOIN n b ON b.path = c.path AND b.name = callee), ls AS (SELECT path, string_agg(line, chr(10) ORDER BY caller, callee) AS links FROM lk GROUP BY 1)
        SELECT path, 'flowchart LR' || chr(10) || nodes || chr(10) || links AS text FROM nd JOIN ls USING (path)""",
    "v_diagram_layers": "WITH RECURSIVE " + B.DAG + f""", {_LAYERS}, x AS (SELECT node, layer, p_name AS label, row_number() OVER (PARTITION BY layer ORDER BY node) AS k, count(*) OVER (PARTITION BY layer) AS n FROM lay JOIN part ON p_partkey = node),
        bx AS (SELECT layer, '  subgraph L' || layer || chr(10) || string_agg('    n' || node || '["' || label || '"]', chr(10) ORDER BY node) || CASE WHEN max(n) > 10 THEN chr(10) || '    more' || layer || '["+ ' || (max(n) - 10) || ' more"]' ELSE '' END || chr(10) || '  end' AS box FROM x WHERE k <= 10 GROUP BY 1),
        dr AS (SELECT src, dst FROM edges WHERE src IN (SELECT node FROM x WHERE k <= 10) AND dst IN (SELECT node FROM x WHERE k <= 10) ORDER BY 1, 2 LIMIT 70)
        SELECT 'flowchart TD' || chr(10) || (SELECT string_agg(box, chr(10) ORDER BY layer) FROM bx) || coalesce(chr(10) || (SELECT string_agg('  n' || src || ' --> n' || dst, chr(10) ORDER BY src, dst) FROM dr), '') AS text""",
    "v_agent_overview": _G() + """, en AS (SELECT 1 AS key, row_number() OVER (ORDER BY fan_out DESC, node) AS rank, to_json({'kind': 'entry', 'node': node, 'name': name, 'fan_out': fan_out})::VARCHAR AS item FROM facts WHERE is_entry QUALIFY rank <= 50),
        hb AS (SELECT 1 AS key, 50 + row_number() OVER (ORDER BY fan_in DESC, node) AS rank, to_json({'kind': 'hub', 'node': node, 'name': name, 'fan_in': fan_in, 'fan_out': fan_out})::VARCHAR AS item FROM facts WHERE fan_in >= 2 QUALIFY rank <= 100), pt AS (SELECT * FROM en UNION ALL SELECT * FROM hb), """ + _packed("pt", A.BUDGET) + """
        SELECT 'overview' AS payload, '{"stats":' || to_json({'files': (SELECT count(*) FROM facts), 'connections': (SELECT count(*) FROM edges), 'orphans': (SELECT count(*) FROM facts WHERE fan_in = 0 AND NOT is_entry AND NOT is_test)})::VARCHAR || ',"parts":[' || items || '],"leftOut":' || left_out || '}' AS json FROM pk""",
    "v_agent_architecture": "WITH RECURSIVE " + B.DAG + f""", {_LAYERS}, {B.edges_sql().replace("edges AS", "e2 AS", 1)}, fe AS (SELECT a.p_brand AS f, b.p_brand AS t, count(*) AS n FROM e2 JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2),
        pt AS (SELECT 1 AS key, layer + 1 AS rank, to_json({{'kind': 'layer', 'depth': layer, 'files': count(*)}})::VARCHAR AS item FROM lay GROUP BY layer UNION ALL SELECT 1, 1048576 + row_number() OVER (ORDER BY n DESC, f, t) AS rank, to_json({{'kind': 'traffic', 'from': f, 'to': t, 'count': n}})::VARCHAR FROM fe QUALIFY rank <= 1048606), """ + _packed("pt", 1_500) + """
        SELECT 'architecture' AS payload, '{"parts":[' || items || '],"leftOut":' || left_out || '}' AS json FROM pk""",
    "v_agent_dependencies": "WITH " + B.DECLARED + """, pt AS (SELECT ecosystem AS key, row_number() OVER (PARTITION BY ecosystem ORDER BY label, name) AS rank, to_json({'name': label, 'version': split_part(regexp_replace(version, '^[~^>=< ]+', ''), ' ', 1), 'dev': dev, 'licence': 'Permissive (Inferred)'})::VARCHAR AS item FROM declared), """ + _packed("pt", A.BUDGET) + """
        SELECT 'dependencies/' || key AS payload, '{"packages":[' || items || '],"leftOut":' || left_out || '}' AS json FROM pk""",
    "v_agent_explain_file": _G() + """, ne AS (SELECT *, row_number() OVER (PARTITION BY node, side ORDER BY other) AS k FROM (SELECT dst AS node, 'importer' AS side, src AS other FROM edges UNION ALL SELECT src, 'import', dst FROM edges)),
        pt AS (SELECT node AS key, row_number() OVER (PARTITION BY node ORDER BY side DESC, other) AS rank, to_json({'side': side, 'other': other})::VARCHAR AS item FROM ne WHERE k <= 20), """ + _packed("pt", 300) + """
        SELECT 'file/' || node AS payload, '{"file":' || to_json({'node': node, 'name': name, 'role': CASE WHEN is_test THEN 'test' WHEN is_entry THEN 'entry' WHEN fan_in >= 5 THEN 'hub' WHEN fan_out = 0 AND fan_in > 0 THEN 'leaf' ELSE 'module' END, 'fan_in': fan_in, 'fan_out': fan_out})::VARCHAR
          || ',"near":[' || coalesce(items, '') || '],"leftOut":' || coalesce(left_out, 0) || '}' AS json FROM facts LEFT JOIN pk ON key = node""",
    "v_agent_search": "WITH " + B.FILES + """, hit AS (SELECT path, text FROM files WHERE contains(path, 'src1') AND path LIKE '%.py' AND contains(path, '/tests/')), top AS (SELECT * FROM hit ORDER BY path LIMIT 40),
        sn AS (SELECT path, regexp_replace(string_split(text, chr(10))[1], '\\r$', '') AS line FROM top), pt AS (SELECT 1 AS key, row_number() OVER (ORDER BY path) AS rank, to_json({'path': path, 'score': 1.0::DOUBLE, 'line': 1, 'snippet': trim(CASE WHEN length(line) > 120 THEN left(line, 118) ELSE line END, ' ' || chr(9) || chr(10) || chr(13))})::VARCHAR AS item FROM sn), """ + _packed("pt", 1_000) + """
        SELECT 'search' AS payload, '{"results":[' || coalesce((SELECT items FROM pk), '') || '],"leftOut":' || coalesce((SELECT left_out FROM pk), 0) || ',"total":' || (SELECT count(*) FROM hit) || '}' AS json""",
    "v_patterns_further": _G() + f""", dp AS (SELECT node, 0 AS d FROM nodes WHERE is_entry UNION SELECT dst, d + 1 FROM dp JOIN edges ON src = node WHERE d < 12), dm AS (SELECT node, min(d) AS d FROM dp GROUP BY 1), ly AS (SELECT coalesce(max(d), -1) + 1 AS n FROM dm),
        cy AS ({graphs.ORACLES["g_scc"]}), cs AS (SELECT component, count(*) AS size FROM cy GROUP BY 1 HAVING size > 1), uh AS ({graphs.ORACLES["join_untested_hubs"]}), de AS ({more.ORACLES["join_deadexport_anti"]}), dr AS ({history.ORACLES["join_drift_anti"]}), ex AS ({history.ORACLES["agg_externals"]}),
        pt AS (SELECT 'layered-shape' AS pattern, 'info' AS severity, n, '' AS example FROM ly WHERE n >= 3 UNION ALL SELECT 'unreachable', 'info', count(*), min(node)::VARCHAR FROM nodes WHERE node NOT IN (SELECT node FROM dm) AND (SELECT n FROM ly) >= 3
          UNION ALL SELECT 'cycles', 'high', count(*), (SELECT component::VARCHAR FROM cs ORDER BY size DESC, component LIMIT 1) FROM cs UNION ALL SELECT 'untested-hubs', 'high', count(*), min(node)::VARCHAR FROM uh UNION ALL SELECT 'dead-exports', 'low', count(*), min(path)::VARCHAR FROM de
          UNION ALL SELECT 'undeclared-deps', 'high', count(*), min(name)::VARCHAR FROM dr WHERE drift = 'undeclared' UNION ALL SELECT 'unused-deps', 'low', count(*), min(name)::VARCHAR FROM dr WHERE drift = 'unused'
          UNION ALL SELECT * FROM (SELECT 'top-external', 'info', users, name::VARCHAR FROM ex WHERE users >= 3 ORDER BY users DESC, name LIMIT 1) UNION ALL SELECT 'services', 'info', 2 * count(*), 'db' FROM supplier UNION ALL SELECT 'no-tests', 'medium', 1, '' WHERE (SELECT count(*) FROM nodes WHERE is_test) = 0)
        SELECT pattern, severity, n::BIGINT AS n, example FROM pt WHERE n > 0""",
    "v_symbol_kinds": code._W + code._EXPORTS + "SELECT lang, x.kind, count(*) AS n FROM (SELECT DISTINCT path, name, kind FROM x) x JOIN (SELECT DISTINCT path, lang FROM p) USING (path) GROUP BY 1, 2",
}
