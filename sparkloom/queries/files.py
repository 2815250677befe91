"""Files: paths, filters, rollups by folder and language, text metrics, rules and licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom.functions import code as C
from sparkloom.functions import paths as P
from sparkloom.operators import findings as R
from sparkloom.operators import folders as D
from sparkloom.queries.search import _line, _snippet
from sparkloom.storage import stage

_FILES = B.files


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return _FILES(spark, sf).select("path", P.dir_of(p).alias("dir"), P.name_of(p).alias("name"), P.ext_of(p).alias("ext"), P.depth_of(p).alias("depth"), P.top_folder(p).alias("top"), P.is_test(p).alias("is_test"))


def path_normalize(spark: SparkSession, sf: str) -> DataFrame:
    p = F.concat(F.lit("./x/../../"), F.col("path"), F.lit("//./y/.."))
    return _FILES(spark, sf).select("path", P.normalize(p).alias("normal"))


def stage_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _FILES(spark, sf).where(P.keeps(F.col("path"), "SRC1", tests=False)).select("path")


def path_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    gate = P.ext_of(p).isin(".js", ".ts") & F.contains(F.lower(p), F.lit("src")) & ~P.is_test(p) & ~F.contains(F.lower(p), F.lit("src1"))
    return _FILES(spark, sf).where(gate).select("path")


def list_files(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    found = _FILES(spark, sf).where(p.startswith("src/src1/") & F.contains(p, F.lit("doc")) & p.endswith(".js")).select("path")
    return found.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total")))).orderBy("path").limit(50).withColumn("truncated", F.col("total") > 50)


def files_under(spark: SparkSession, sf: str) -> DataFrame:
    return _FILES(spark, sf).where(F.col("path").startswith("src/src2/")).select("path", "lang")


def skip_counters(spark: SparkSession, sf: str) -> DataFrame:
    f = _FILES(spark, sf)
    bent = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("vendor/"), F.col("path"))).when(F.col("doc_id") % 13 == 0, F.concat("path", F.lit(".min.js"))).when(F.col("doc_id") % 17 == 0, F.concat("path", F.lit(".md"))).otherwise(F.col("path"))
    reason = P.skip_reason(bent, F.length("text"), 20_000)
    return f.groupBy(F.coalesce(reason, F.lit("parsed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def lang_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return _FILES(spark, sf).select("path", "lang")


def agg_language(spark: SparkSession, sf: str) -> DataFrame:
    return D.languages(_FILES(spark, sf))


def agg_folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return D.rollup(_FILES(spark, sf))


def agg_subtree_count(spark: SparkSession, sf: str) -> DataFrame:
    return D.subtree_counts(_FILES(spark, sf))


def agg_test_shadow(spark: SparkSession, sf: str) -> DataFrame:
    return _FILES(spark, sf).agg(F.count_if(P.is_test(F.col("path"))).alias("tests"), F.count(F.lit(1)).alias("files")).withColumn("share", C.round_half_up(100.0 * F.col("tests") / F.greatest(F.col("files"), F.lit(1))))


def tree_prune(spark: SparkSession, sf: str) -> DataFrame:
    return D.pruned_tree(_FILES(spark, sf), "doc_1")


def code_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _FILES(spark, sf).select("path", C.code_stats(F.col("text"), F.col("lang")).alias("s")).select("path", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("lines", "code", "comment", "blank")))


def complexity(spark: SparkSession, sf: str) -> DataFrame:
    return _FILES(spark, sf).select("path", C.complexity(F.col("text"), F.col("lang")).alias("complexity"))


def cognitive(spark: SparkSession, sf: str) -> DataFrame:
    return _FILES(spark, sf).select("path", C.cognitive(F.col("text"), F.col("lang")).alias("cognitive"))


def halstead(spark: SparkSession, sf: str) -> DataFrame:
    h = _FILES(spark, sf).select("path", C.halstead(F.col("text"), F.col("lang")).alias("h"))
    return h.select("path", *(F.col(f"h.{a}").cast("long").alias(b) for a, b in (("n1", "ops"), ("n2", "names"), ("t1", "all_ops"), ("t2", "all_names"))), *(F.round(f"h.{c}", 4).alias(c) for c in ("volume", "difficulty")))


def maintainability(spark: SparkSession, sf: str) -> DataFrame:
    t, lang = F.col("text"), F.col("lang")
    f = _FILES(spark, sf).select("path", C.halstead(t, lang).alias("h"), C.complexity(t, lang).alias("cx"), C.code_stats(t, lang).alias("s"))
    return f.select("path", F.round(C.maintainability(F.col("h.volume"), F.col("cx"), F.col("s.code")), 4).alias("mi"), C.doc_ratio(F.col("s.comment"), F.col("s.code")).alias("doc_ratio"))


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return _FILES(spark, sf).select("path", F.explode(C.tokens(F.col("text"))).alias("token")).groupBy("path", "token").agg(F.count(F.lit(1)).alias("tf"))


def binary_sniff(spark: SparkSession, sf: str) -> DataFrame:
    return _FILES(spark, sf).select("path", F.contains(F.left("text", F.lit(1000)), F.expr("char(0)")).alias("is_binary"))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _FILES(spark, sf).where(F.contains(t, F.lit("idiot"))).select("path", C.line_of(t, "idiot").alias("line"), C.snippet(t, "idiot").alias("snippet"))


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return B.table(spark, sf, "pages").select("page_id", C.html_title(h).alias("title"), C.html_text(h).alias("text"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Diagram labels, short names and clean versions of dependencies."""
    return B.declared(spark, sf).select("name", C.mermaid_text(F.concat(F.col("label"), F.lit(" [x] & "), F.col("version"))).alias("label"), C.short_name(F.concat_ws("/", "label", "ecosystem", "version", "label")).alias("short"), C.clean_version(F.col("version")).alias("version"))


def severities(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "Error").when(F.col("event_id") % 5 == 1, "warn").when(F.col("event_id") % 5 == 2, F.col("event_type")).when(F.col("event_id") % 5 == 3, "note").otherwise("CRITICAL").alias("word"))
    return e.select("event_id", C.normalize_severity(F.col("word")).alias("severity")).withColumn("rank", C.severity_rank(F.col("severity")))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    pages = B.table(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.col("html").alias("text"), F.lit("javascript").alias("lang"))
    return R.scan(pages.unionByName(_FILES(spark, sf).select("path", "text", "lang")).unionByName(B.code(spark, sf)), extra=R.CORPUS_RULES)


def rules_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).select("path", "line", "rule", "severity", "category", "excerpt")


def agg_security_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.summary(_findings(spark, sf))


def win_worst_severity(spark: SparkSession, sf: str) -> DataFrame:
    return R.worst_by_file(_findings(spark, sf))


def top_security_files(spark: SparkSession, sf: str) -> DataFrame:
    return R.worst_by_file(_findings(spark, sf)).orderBy(F.desc("worst_rank"), F.desc("n"), "path").limit(20)


def top_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).select(C.severity_rank(F.col("severity")).alias("rank"), "path", "line", "rule").orderBy(F.desc("rank"), "path", "line", "rule").limit(40)


def agg_tabulate(spark: SparkSession, sf: str) -> DataFrame:
    return R.tabulate(_findings(spark, sf).withColumn("tool", F.when(F.col("rule").startswith("corpus-"), "external").otherwise("builtin")))


def filter_findings(spark: SparkSession, sf: str) -> DataFrame:
    return R.matching(_findings(spark, sf), severity="info", text="licen").select("path", "line", "rule")


def findings_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of a second engine on files, merged: known paths only, one row a path, line and rule."""
    own = stage(_findings(spark, sf).select("path", "line", "rule", "severity"), "findings")  # read four times
    outside = own.where(F.col("line") % 2 == 1).withColumn("severity", F.lit("low"))
    unknown = own.limit(0).unionByName(own.where("line = 1").withColumn("path", F.concat(F.lit("gone/"), "path")))
    return R.merge(own, outside.unionByName(unknown), own.select("path").distinct())


def licence_detect(spark: SparkSession, sf: str) -> DataFrame:
    f = _FILES(spark, sf).select("path", R.licence_of(F.col("text")).alias("licence")).where("licence is not null")
    return f.withColumn("kind", R.licence_kind(F.col("licence")))


QUERIES = {f.__name__: f for f in (
    path_parts, path_normalize, stage_filter, path_gate, list_files, files_under, skip_counters, lang_dispatch, agg_language, agg_folder_rollup, agg_subtree_count,
    agg_test_shadow, tree_prune, code_stats, complexity, cognitive, halstead, maintainability, tokenize, binary_sniff, snippets, html_to_text, labels, severities,
    rules_scan, agg_security_summary, win_worst_severity, top_security_files, top_findings, agg_tabulate, filter_findings, findings_merge, licence_detect,
)}

_TEST = r"'(?i)(^|[._\-/])(test|tests|spec|specs|__tests__|__test__)([._\-/]|$)'"
_W = "WITH " + B.FILES
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEAN = r"""clean AS (SELECT path, text, lang, CASE WHEN lang = 'python' THEN regexp_replace(c, '(?m)^[ \t]*#[^\n]*', '', 'g') ELSE regexp_replace(c, '//[^\n]*', '', 'g') END AS c
  FROM (SELECT *, regexp_replace(text, '/\*[^\n]*?\*/', ' ', 'g') AS c FROM files))"""
_STATS = rf"""
lines AS (SELECT path, lang, unnest(string_split(text, chr(10))) AS l FROM files),
kinds AS (SELECT path, CASE WHEN t = '' THEN 'blank' WHEN starts_with(t, '//') OR starts_with(t, '/*') OR (lang = 'python' AND starts_with(t, '#')) THEN 'comment' ELSE 'code' END AS kind
          FROM (SELECT path, lang, {_TRIM.format("l")} AS t FROM lines)),
stats AS (SELECT path, count(*) AS lines, count(*) FILTER (kind = 'code') AS code, count(*) FILTER (kind = 'comment') AS comment, count(*) FILTER (kind = 'blank') AS blank FROM kinds GROUP BY 1)
"""
_WORDS = r"""len(regexp_extract_all(c, CASE lang WHEN 'javascript' THEN '\b(?:if|for|while|case|catch|do|else if)\b' WHEN 'python' THEN '\b(?:if|elif|for|while|except)\b'
  WHEN 'go' THEN '\b(?:if|for|case|go|select)\b' ELSE '\b(?:if|elif|for|while|case|catch|except|switch)\b' END))"""
_CX = rf"(1 + {_WORDS} + len(regexp_extract_all(c, '&&|\|\||\?')))::BIGINT"
_OPS = C.operator_pattern()
_HAL = rf"""
hal AS (SELECT path, lang, c, regexp_extract_all(c, '{_OPS}') AS o,
        list_filter(regexp_extract_all(c, '\b[a-zA-Z_][a-zA-Z0-9_]*\b|\b\d+\b|[''"][^''"]*[''"]'), lambda w: w NOT IN ('{"', '".join(C.KEYWORDS)}')) AS n FROM clean),
h4 AS (SELECT path, lang, c, len(list_distinct(o))::BIGINT AS ops, len(list_distinct(n))::BIGINT AS names, len(o)::BIGINT AS all_ops, len(n)::BIGINT AS all_names FROM hal),
h AS (SELECT *, CASE WHEN ops + names = 0 THEN 0.0 ELSE (all_ops + all_names) * log2((ops + names)::DOUBLE) END AS volume,
      CASE WHEN ops = 0 OR names = 0 THEN 0.0 ELSE ops / 2.0 * (all_names / names::DOUBLE) END AS difficulty FROM h4)
"""
_ALL_RULES = [*R.RULES, *R.CORPUS_RULES]


def _rule_sql(r: R.Rule) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    langs = f"lang IN ({', '.join(map(quote, r.langs))}) AND " if r.langs else ""
    skip = f"NOT regexp_matches(l, {quote(r.sql_ignore or r.ignore)}) AND " if r.ignore else ""
    return f"SELECT path, line, {quote(r.id)} AS rule, {quote(r.severity)} AS severity, {quote(r.category)} AS category, l FROM every WHERE {langs}{skip}regexp_matches(l, {quote(r.sql or r.pattern)})"


_FINDINGS = (
    "WITH "
    + B.FILES
    + ", "
    + B.code_sql()
    + """, texts AS (SELECT path, text, lang FROM code UNION ALL SELECT 'pages/' || page_id || '.js' AS path, html AS text, 'javascript' AS lang FROM pages UNION ALL SELECT path, text, lang FROM files),
cut AS (SELECT path, lang, string_split(text, chr(10)) AS a FROM texts),
every AS (SELECT path, lang, unnest(a) AS l, unnest(range(1, len(a) + 1)) AS line FROM cut),
found AS ("""
    + " UNION ALL ".join(map(_rule_sql, _ALL_RULES))
    + rf"""), findings AS (SELECT path, line::BIGINT AS line, rule, severity, category, left({_TRIM.format("l")}, 90) AS excerpt,
  list_position(['info', 'low', 'medium', 'high', 'critical'], severity)::INTEGER - 1 AS rank FROM found)
"""
)
_WORST = "SELECT path, max(rank) AS worst_rank, count(*) AS n FROM findings GROUP BY 1"

ORACLES = {
    "path_parts": _W + rf"""SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, split_part(path, '/', -1) AS name, '.' || split_part(path, '.', -1) AS ext,
        len(string_split(path, '/'))::INTEGER AS depth, split_part(path, '/', 1) AS top, regexp_matches(path, {_TEST}) AS is_test FROM files""",
    "path_normalize": _W + "SELECT path, path AS normal FROM files",
    "stage_filter": _W + rf"SELECT path FROM files WHERE contains(lower(path), 'src1') AND NOT regexp_matches(path, {_TEST})",
    "path_gate": _W + rf"SELECT path FROM files WHERE regexp_matches(path, '\.(js|ts)$') AND NOT contains(path, 'src1') AND NOT regexp_matches(path, {_TEST})",
    "list_files": _W + ", f AS (SELECT path FROM files WHERE starts_with(path, 'src/src1/') AND path LIKE '%.js') SELECT path, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 50 AS truncated FROM f ORDER BY path LIMIT 50",
    "files_under": _W + "SELECT path, lang FROM files WHERE starts_with(path, 'src/src2/')",
    "skip_counters": _W + "SELECT CASE WHEN doc_id % 11 = 0 THEN 'vendorDir' WHEN doc_id % 13 = 0 THEN 'notSource' WHEN doc_id % 17 = 0 THEN 'notCode' WHEN length(text) > 20000 THEN 'tooLarge' ELSE 'parsed' END AS reason, count(*) AS n FROM files GROUP BY 1",
    "lang_dispatch": _W + "SELECT path, lang FROM files",
    "agg_language": _W + "," + _STATS + "SELECT lang, count(*) AS files, sum(code)::BIGINT AS loc FROM files JOIN stats USING (path) GROUP BY 1",
    "agg_folder_rollup": _W + "," + _STATS + r"""SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, len(string_split(path, '/')) - 1 AS depth, count(*) AS files, sum(code)::BIGINT AS loc, sum(comment)::BIGINT AS comment, sum(blank)::BIGINT AS blank,
        sum(length(text))::BIGINT AS size, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, CASE WHEN sum(code) + sum(comment) = 0 THEN 0 ELSE floor(100.0 * sum(comment) / (sum(code) + sum(comment)) + 0.5) END::BIGINT AS doc_ratio
        FROM files JOIN stats USING (path) GROUP BY 1, 2""",
    "agg_subtree_count": _W + ", a AS (SELECT unnest([array_to_string(string_split(path, '/')[1:k], '/') for k in range(0, len(string_split(path, '/')))]) AS dir FROM files) SELECT dir, count(*) AS files FROM a GROUP BY 1",
    "agg_test_shadow": _W + rf"SELECT count(*) FILTER (regexp_matches(path, {_TEST})) AS tests, count(*) AS files, floor(100.0 * count(*) FILTER (regexp_matches(path, {_TEST})) / count(*) + 0.5)::BIGINT AS share FROM files",
    "tree_prune": _W + ", k AS (SELECT path FROM files WHERE contains(path, 'doc_1')), a AS (SELECT unnest([array_to_string(string_split(path, '/')[1:k], '/') for k in range(0, len(string_split(path, '/')))]) AS node FROM k) SELECT node, 'folder' AS kind, count(*) AS files FROM a GROUP BY 1 UNION ALL SELECT path, 'file', 1 FROM k",
    "code_stats": _W + "," + _STATS + "SELECT * FROM stats",
    "complexity": _W + "," + _CLEAN + f"SELECT path, {_CX} AS complexity FROM clean",
    "halstead": _W + "," + _CLEAN + "," + _HAL + "SELECT path, ops, names, all_ops, all_names, round(volume, 4) AS volume, round(difficulty, 4) AS difficulty FROM h",
    "cognitive": _W + "," + _CLEAN + r""", l AS (SELECT path, list_transform(string_split(c, chr(10)), lambda x: {'score': 0::BIGINT, 'depth': 0::BIGINT, 'opens': contains(x, '{')::BIGINT, 'closes': contains(x, '}'),
          'block': regexp_matches(x, '\b(if|for|while|do|switch|catch)\b'), 'loose': regexp_matches(x, '\b(if|else if|for|while|do|catch)\b'),
          'plain': regexp_matches(regexp_replace(x, '\belse\s+if', '', 'g'), '\belse\b')::BIGINT + len(regexp_extract_all(x, '&&|\|\||\?'))}) AS x FROM clean),
        f AS (SELECT path, list_reduce(list_prepend({'score': 0::BIGINT, 'depth': 0::BIGINT, 'opens': 0::BIGINT, 'closes': false, 'block': false, 'loose': false, 'plain': 0::BIGINT}, x), lambda a, y: {
          'score': a.score + CASE WHEN y.opens = 1 AND y.block THEN 1 + a.depth ELSE 0 END + CASE WHEN y.opens = 0 AND y.loose THEN 1 + CASE WHEN y.closes THEN greatest(a.depth - 1, 0) ELSE a.depth END ELSE 0 END + y.plain,
          'depth': CASE WHEN y.closes THEN greatest(a.depth + y.opens - 1, 0) ELSE a.depth + y.opens END, 'opens': 0::BIGINT, 'closes': false, 'block': false, 'loose': false, 'plain': 0::BIGINT}) AS r FROM l)
        SELECT path, r.score AS cognitive FROM f""",
    "maintainability": _W + "," + _CLEAN + "," + _HAL + "," + _STATS + rf"""SELECT path, round(CASE WHEN volume = 0 OR code = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, (171 - 5.2 * ln(volume) - 0.23 * {_CX} - 16.2 * ln(code::DOUBLE)) * 100 / 171)) END, 4) AS mi,
        CASE WHEN comment + code = 0 THEN 0 ELSE floor(100.0 * comment / (comment + code) + 0.5) END::BIGINT AS doc_ratio FROM h JOIN stats USING (path)""",
    "tokenize": _W + r", t AS (SELECT path, unnest(regexp_split_to_array(lower(text), '\W+')) AS token FROM files) SELECT path, token, count(*) AS tf FROM t WHERE length(token) > 1 GROUP BY 1, 2",
    "binary_sniff": _W + "SELECT path, contains(left(text, 1000), chr(0)) AS is_binary FROM files",
    "snippets": _W + f", x AS (SELECT path, text, strpos(text, 'idiot') AS pos_ FROM files WHERE contains(text, 'idiot')) SELECT path, {_line('pos_')} AS line, {_snippet('pos_', 120)} AS snippet FROM x",
    "html_to_text": r"""SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([\s\S]*?)</title>', 1)) AS title, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[\s\S]*?</script>', ' ', 'g'), '(?i)<style[\s\S]*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), 14000) AS text FROM pages""",
    "labels": "WITH " + B.DECLARED + r"""SELECT name, left(replace(regexp_replace(label || ' [x] & ' || version, '["<>|{}\[\]()]', '', 'g'), '&', 'and'), 80) AS label,
        CASE WHEN length(s) > 34 THEN left(s, 33) || '…' ELSE s END AS short, replace(split_part(version, ' ', 1), '^', '') AS version FROM (SELECT *, label || '/' || ecosystem || '/' || version || '/' || label AS s FROM declared)""",
    "severities": """SELECT event_id, s AS severity, (list_position(['info', 'low', 'medium', 'high', 'critical'], s) - 1)::INTEGER AS rank FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN CASE event_type WHEN 'error' THEN 'high' ELSE 'info' END WHEN 3 THEN 'low' ELSE 'critical' END AS s FROM events)""",
    "rules_scan": _FINDINGS + "SELECT path, line, rule, severity, category, excerpt FROM findings",
    "agg_security_summary": _FINDINGS + """, c AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, count(*) AS total FROM findings),
        s AS (SELECT *, greatest(0, 100 - 15 * critical - 6 * high - 2 * medium - least(10, low))::BIGINT AS score FROM c)
        SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade FROM s""",
    "win_worst_severity": _FINDINGS + _WORST,
    "top_security_files": _FINDINGS + _WORST + " ORDER BY worst_rank DESC, n DESC, path LIMIT 20",
    "top_findings": _FINDINGS + "SELECT rank, path, line, rule FROM findings ORDER BY rank DESC, path, line, rule LIMIT 40",
    "agg_tabulate": _FINDINGS + """SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(tool) = 0 THEN 'tool' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS by_, coalesce(severity, tool, category, '') AS value, count(*) AS n
        FROM (SELECT *, CASE WHEN starts_with(rule, 'corpus-') THEN 'external' ELSE 'builtin' END AS tool FROM findings) GROUP BY GROUPING SETS ((severity), (tool), (category), ())""",
    "filter_findings": _FINDINGS + "SELECT path, line, rule FROM findings WHERE severity = 'info' AND (contains(lower(path), 'licen') OR contains(lower(rule), 'licen') OR contains(lower(excerpt), 'licen') OR contains(lower(category), 'licen'))",
    "findings_merge": _FINDINGS + """, o AS (SELECT path, line, rule, severity, 0 AS k FROM findings UNION ALL SELECT path, line, rule, 'low', 1 FROM findings WHERE line % 2 = 1)
        SELECT path, line, rule, severity, CASE k WHEN 0 THEN 'builtin' ELSE 'external' END AS source FROM o QUALIFY row_number() OVER (PARTITION BY path, line, rule ORDER BY k, severity) = 1""",
    "licence_detect": _W + r""", l AS (SELECT path, CASE WHEN regexp_matches(text, '\b[mM][iI][tT]\b|(?i)Permission is hereby granted, free of charge') THEN 'MIT' WHEN regexp_matches(text, '(?i)Apache License,\s*Version 2\.0') THEN 'Apache-2.0'
        WHEN regexp_matches(text, '(?i)GNU GENERAL PUBLIC LICENSE\s+Version 3|GPL-3\.0') THEN 'GPL-3.0' WHEN regexp_matches(text, '(?i)GNU GENERAL PUBLIC LICENSE\s+Version 2|GPL-2\.0') THEN 'GPL-2.0' WHEN regexp_matches(text, '(?i)GNU AFFERO') THEN 'AGPL-3.0' END AS licence FROM files)
        SELECT path, licence, CASE licence WHEN 'MIT' THEN 'permissive' WHEN 'Apache-2.0' THEN 'permissive' ELSE 'copyleft' END AS kind FROM l WHERE licence IS NOT NULL""",
}
