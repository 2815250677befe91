"""Code analysis over parts as source files: statements, calls, imports and what they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import code_tables as K
from sparkloom.functions import code as C
from sparkloom.operators import resolution as R
from sparkloom.operators import symbols as S
from sparkloom.storage import stage


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return S.extract(K.sources(spark, sf))


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found, files = stage(_found(spark, sf), "statements"), K.repository(spark, sf)
    return found, R.resolve(found, files), files


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """All statements of all code files but calls."""
    names = F.array_join("names", ",").alias("names")
    return _found(spark, sf).where("kind <> 'call'").select("path", F.col("line").cast("long").alias("line"), "kind", "detail", "name", names)


def v_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """How many files name a symbol, by kind, and the first of them."""
    found = _found(spark, sf).where("kind in ('import', 'function', 'class', 'interface')")
    return found.groupBy("kind", "name").agg(F.countDistinct("path").alias("files"), F.min("path").alias("first"))


def code_exports(spark: SparkSession, sf: str) -> DataFrame:
    return S.exports(_found(spark, sf))


def code_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that call others of their file."""
    return S.calls(stage(_found(spark, sf), "statements")).withColumn("line", F.col("line").cast("long"))


def code_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Where every import leads."""
    _, resolved, _ = _resolved(spark, sf)
    return resolved.select("path", F.col("line").cast("long").alias("line"), "name", "state", F.coalesce("target", "package", "outside").alias("to"))


def code_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The import graph of files with the names that are imported."""
    _, resolved, files = _resolved(spark, sf)
    return R.edges(resolved, files).withColumn("symbols", F.array_join("symbols", ","))


def code_tally(spark: SparkSession, sf: str) -> DataFrame:
    """How many imports were placed."""
    return R.tally(_resolved(spark, sf)[1])


def code_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    """The imports that most often lead nowhere."""
    return R.worst(_resolved(spark, sf)[1])


def code_dead_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Exports that no import names; files of the last folders are spared."""
    found, resolved, _ = _resolved(spark, sf)
    spared = K.sources(spark, sf).where(F.col("path").rlike("^gen/d[0-2]/")).select("path")
    return S.dead_exports(S.exports(found).select("path", "name"), S.used_names(resolved), spared)


def js_code_mask(spark: SparkSession, sf: str) -> DataFrame:
    """What is code in scripts, without blanks, and that every character keeps its place."""
    files = K.sources(spark, sf).where("lang in ('javascript', 'typescript')").withColumn("mask", C.js_code_mask(F.col("text")))
    return files.select("path", F.regexp_replace("mask", r"\s", "").alias("code"), (F.length("mask") == F.length("text")).alias("aligned"))


def brace_body(spark: SparkSession, sf: str) -> DataFrame:
    """The body of the first exported function of scripts."""
    files = K.sources(spark, sf).where("lang = 'javascript'").withColumn("at", F.instr("text", ") {\n") + 2)
    return files.select("path", C.brace_body(F.col("text"), F.col("at")).alias("body"))


def calls_within(spark: SparkSession, sf: str) -> DataFrame:
    """Which of three names each script calls, in the order of the names."""
    key = F.regexp_extract("path", r"p(\d+)\.", 1)
    names = F.array(*(F.concat(F.lit(x), key, F.lit("_0")) for x in ("wrap_", "none_", "load_")))
    return K.sources(spark, sf).where("lang = 'javascript'").select("path", F.array_join(C.calls_within(F.col("text"), names), ",").alias("called"))


QUERIES = {f.__name__: f for f in (symbols, v_symbols, code_exports, code_calls, code_imports, code_edges, code_tally, code_unresolved, code_dead_exports, js_code_mask, brace_body, calls_within)}

_W = "WITH " + K.statements_sql()
#: Where an import leads, told from the keys alone: the next file of the language, if there is such a part.
_TO = f""", m AS (SELECT max(p_partkey) AS top FROM part), imp AS (SELECT found.*, k + 8 AS n, (k + 8) // {K.FOLDER} AS e, k // {K.FOLDER} AS d, k + 8 <= top AS there FROM found, m WHERE kind = 'import'),
to_ AS (SELECT *, CASE
    WHEN lang = 'javascript' AND there THEN 'gen/d' || e || '/p' || n || '.js' WHEN lang = 'typescript' AND there THEN 'gen/d' || e || '/p' || n || '.ts'
    WHEN lang = 'python' AND detail = 'from' AND there AND d = e THEN 'gen/d' || d || '/p' || n || '.py' WHEN lang = 'rust' AND name LIKE 'super%' AND there AND d = e THEN 'gen/d' || d || '/p' || n || '.rs'
    WHEN lang = 'java' AND detail = '' AND there THEN 'gen/d' || e || '/p' || n || '.java' WHEN lang = 'csharp' AND detail = '' AND there THEN 'gen/d' || e || '/p' || n || '.cs'
    WHEN lang = 'generic' AND detail = 'local' AND there THEN 'gen/d' || e || '/p' || n || '.c' END AS target,
  CASE WHEN lang = 'python' AND detail = 'import' THEN split_part(name, '.', 1) WHEN lang = 'go' AND name = 'fmt' THEN 'fmt' WHEN detail = 'system' THEN name END AS outside FROM imp),
res AS (SELECT *, CASE WHEN target IS NOT NULL THEN 'file' WHEN outside IS NOT NULL THEN 'outside' ELSE 'unresolved' END AS state FROM to_)"""
_EXPORTS = """, x AS (SELECT path, name, CASE WHEN kind = 'export' OR lang = 'go' THEN detail ELSE kind END AS kind FROM found WHERE kind = 'export' OR (kind IN ('function', 'class') AND CASE lang
    WHEN 'python' THEN NOT starts_with(name, '_') AND detail <> 'method' WHEN 'go' THEN kind = 'function' AND regexp_matches(name, '^[A-Z]') WHEN 'rust' THEN detail = 'pub' WHEN 'java' THEN kind = 'class' WHEN 'csharp' THEN kind = 'class' ELSE false END))"""
_HIDDEN = r"""//[^\n]*|/\*(?s:.*?)\*/|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`"""
ORACLES = {
    "symbols": _W + "SELECT path, line::BIGINT AS line, kind, detail, name, names FROM found",
    "v_symbols": _W + "SELECT kind, name, count(DISTINCT path) AS files, min(path) AS \"first\" FROM found WHERE kind IN ('import', 'function', 'class', 'interface') GROUP BY 1, 2",
    "code_exports": _W + _EXPORTS + "SELECT path, name, kind FROM x",
    "code_calls": _W + """, s AS (SELECT path, k, b, CASE lang WHEN 'javascript' THEN 1 + b * 9 ELSE 3 + b * 10 END AS line0, lang FROM p)
        SELECT path, 'load_' || k || '_' || b AS caller, 'wrap_' || k || '_' || b AS callee, (line0 + 6)::BIGINT AS line FROM s WHERE lang = 'javascript' UNION ALL SELECT path, 'wrap_' || k || '_' || b, 'load_' || k || '_' || b, line0 + 8 FROM s WHERE lang = 'javascript'
        UNION ALL SELECT path, '_open', 'run_' || k || '_' || b, line0 + 6 FROM s WHERE lang = 'python'""",
    "code_imports": _W + _TO + "SELECT path, line::BIGINT AS line, name, state, coalesce(target, outside) AS \"to\" FROM res",
    "code_edges": _W + _TO + ", n AS (SELECT path, target, unnest(CASE WHEN names = '' THEN [NULL] ELSE string_split(names, ',') END) AS s FROM res WHERE target IS NOT NULL) SELECT path AS src, target AS dst, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS symbols FROM n GROUP BY 1, 2",
    "code_tally": _W + _TO + "SELECT count(*) AS total, count(*) FILTER (state = 'file') AS internal, count(*) FILTER (state = 'outside') AS external, count(*) FILTER (state = 'unresolved') AS unresolved, floor(100.0 * count(*) FILTER (state <> 'unresolved') / count(*) + 0.5)::BIGINT AS confidence FROM res",
    "code_unresolved": _W + _TO + "SELECT name, count(*) AS n, min(path) AS example FROM res WHERE state = 'unresolved' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "code_dead_exports": _W + _TO + _EXPORTS + """, u AS (SELECT target, unnest(CASE WHEN names = '' THEN ['*'] ELSE string_split(names, ',') END) AS name FROM res WHERE target IS NOT NULL)
        SELECT path, name FROM x WHERE NOT regexp_matches(path, '^gen/d[0-2]/') AND path NOT IN (SELECT target FROM u WHERE name = '*') AND (path, name) NOT IN (SELECT (target, name) FROM u)""",
    "js_code_mask": "WITH " + K.sources_sql() + f"SELECT path, regexp_replace(regexp_replace(text, {K._quoted(_HIDDEN)}, '', 'g'), '\\s', '', 'g') AS code, true AS aligned FROM sources WHERE lang IN ('javascript', 'typescript')",
    "brace_body": "WITH " + K.sources_sql() + r"SELECT path, regexp_extract(text, '\) (\{\n(?s:.*?)\n\})', 1) AS body FROM sources WHERE lang = 'javascript'",
    "calls_within": "SELECT 'gen/d' || (p_partkey // 64) || '/p' || p_partkey || '.js' AS path, 'wrap_' || p_partkey || '_0,load_' || p_partkey || '_0' AS called FROM part WHERE p_partkey % 8 = 0",
}
