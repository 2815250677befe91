"""Search over documents as source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom import code_tables as K
from sparkloom.functions import paths as P
from sparkloom.operators import search as S
from sparkloom.operators import symbols as Y
from sparkloom.storage import spread

TERMS = ["the", "license", "idiot"]


def q_index(spark: SparkSession, sf: str) -> DataFrame:
    postings, sizes = S.index(B.files(spark, sf).select("path", "text"))
    return postings.join(sizes, "path")


def q_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return S.tfidf(B.files(spark, sf).select("path", "text"), TERMS)


PATHS = S.Query(terms=("doc_1", "src1"))
TEXTS = S.Query(terms=("and", "that"), phrases=(" the ",))
BOTH = S.Query(terms=("s",))
SYMBOLS = S.Query(terms=("ring",), negatives=("red",), kinds=("economy", "small"))


def q_score_path(spark: SparkSession, sf: str) -> DataFrame:
    return B.files(spark, sf).select("path", F.round(S.path_score(F.col("path"), PATHS), 4).alias("score"))


def q_score_content(spark: SparkSession, sf: str) -> DataFrame:
    return B.files(spark, sf).select("path", F.round(S.content_score(F.col("text"), TEXTS), 4).alias("score")).where("score <> 0")


def q_score_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as symbols, their type as kind."""
    return B.table(spark, sf, "part").select("p_partkey", F.round(S.symbol_score(F.col("p_name"), F.col("p_type"), SYMBOLS), 4).alias("score"))


def q_strict(spark: SparkSession, sf: str) -> DataFrame:
    gate = P.ext_of(F.col("path")).isin(".js") & ~P.is_test(F.col("path"))
    return S.strict(B.files(spark, sf), gate, BOTH).drop("line", "snippet")


def q_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "part").select("p_partkey", F.round(S.fuzzy(F.initcap("p_name"), "rng"), 4).alias("score"))


def q_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "part").select("p_partkey", F.round(S.occurrence(F.lower("p_name"), "r", 100.0), 4).alias("score"))


def highlight(spark: SparkSession, sf: str) -> DataFrame:
    """How much of every part's name is marked, and where first."""
    marks = S.highlight(F.col("p_name"), S.Query(terms=("e", "r", "re")))
    out = B.table(spark, sf, "part").select("p_partkey", marks.alias("m"))
    return out.select("p_partkey", F.size("m").cast("long").alias("ranges"), F.aggregate("m", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]).alias("marked"), F.coalesce(F.get("m", F.lit(0))["start"], F.lit(-1)).cast("long").alias("first"))


#: A query a part: words, a phrase, a pattern, filters, and some that say nothing.
RAW = "concat(p_name, ' \"', p_type, ' Part ', p_size, '\"  -', p_brand, ' EXT:JS,.ts,, path:', p_brand, ' kind:Class is:', if(p_size % 2 = 0, 'Tests', 'other'), ' /P', p_size, '.*/', if(p_size % 3 = 0, 'gi', ''), ' in: \"\" u:', p_size, ' -')"


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    parts = B.table(spark, sf, "part")
    raw = parts.select("p_partkey", F.expr(RAW).alias("raw"))
    return spread(raw, parts.count(), "p_partkey").withColumn("q", S.parse(F.col("raw")))


def q_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of a table of queries."""
    kinds = ("term", "phrase", "neg", "ext", "path", "kind", "is", "regex")
    flags = F.array_join(F.transform("q.clauses", lambda c: F.coalesce(c["flags"], F.lit(""))), "")
    spans = F.forall("q.clauses", lambda c: F.substring(F.col("raw"), c["start"] + 1, c["end"] - c["start"]) == c["raw"])
    return _parsed(spark, sf).select("p_partkey", *(F.array_join(S.values(F.col("q"), k), "|").alias(k) for k in kinds), flags.alias("flags"), F.size("q.clauses").cast("long").alias("n"), spans.alias("spans"))


def q_remove_clause(spark: SparkSession, sf: str) -> DataFrame:
    """Each query without its second, its last and no clause."""
    at = lambda k: F.element_at("q.clauses", k)
    out = _parsed(spark, sf)
    cut = lambda c: S.without_clause(F.col("raw"), c["start"], c["end"])
    return out.select("p_partkey", cut(at(2)).alias("second"), cut(at(-1)).alias("last"), S.without_clause(F.col("raw"), F.lit(5), F.lit(5)).alias("none"))


def q_flags(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of query four beginnings of names are."""
    raw = F.expr("case p_size % 4 when 0 then '  ' when 1 then p_name when 2 then concat('ext:', p_type) else concat('\"', p_name, '\"') end")
    return B.table(spark, sf, "part").select("p_partkey", S.flags(S.parse(raw)).alias("f")).select("p_partkey", "f.empty", "f.filters", "f.advanced")


#: One query each of words, of filters alone, and of all parts.
ASKED = ("the license", "path:src1 ext:py is:test", 'that "the " /ing\\b/ -tests ext:js,ts')


def q_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to three queries, ranked or enforced."""
    files = B.files(spark, sf).select("path", "text")
    parts = [S.search(files, S.compiled(spark, raw), 20).select(F.lit(k).alias("k"), "path", F.round("score", 4).alias("score"), "line", "snippet") for k, raw in enumerate(ASKED)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_total(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts answer the enforced queries."""
    files = B.files(spark, sf).select("path", "text")
    parts = [S.search_total(files, S.compiled(spark, raw)).select(F.lit(k).alias("k"), "total") for k, raw in enumerate(ASKED)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols of scripts, each name of a file once."""
    found = Y.extract(K.sources(spark, sf).where("lang = 'javascript'"))
    return S.symbols_of(found).withColumn("line", F.coalesce("line", F.lit(0)).cast("long"))


def q_palette(spark: SparkSession, sf: str) -> DataFrame:
    """Files and symbols that answer a query."""
    files = K.sources(spark, sf)
    query = S.compiled(spark, "wrap path:d1 ext:js")
    return S.palette(files, S.symbols_of(Y.extract(files.where("lang = 'javascript'"))), query).withColumn("line", F.col("line").cast("long"))


def snippet_at(spark: SparkSession, sf: str) -> DataFrame:
    """The surroundings of the first ``and`` of every file."""
    place = F.instr(F.lower("text"), "and")
    return B.files(spark, sf).select("path", S.line_at(F.col("text"), place).alias("line"), S.snippet_at(F.col("text"), place, 60).alias("snippet"))


def highlight_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of a pattern and a word in parts' names."""
    marks = S.highlight(F.col("p_name"), S.Query(terms=("ed",), pattern="(?i)[E-G]+|r(?=i)|z*"))
    return B.table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(marks, lambda r: F.concat_ws("-", r["start"], r["stop"])), ",").alias("marks"))


QUERIES = {f.__name__: f for f in (
    q_index, q_tfidf, q_score_path, q_score_content, q_score_symbol, q_strict, q_fuzzy, q_occurrence, highlight, q_parse, q_remove_clause, q_flags, q_dispatch, q_total, q_symbols, q_palette,
    snippet_at, highlight_pattern,
)}

_P = "WITH " + B.FILES + r", tok AS (SELECT path, unnest(regexp_split_to_array(lower(text), '\W+')) AS token FROM files), post AS (SELECT path, token, count(*) AS tf FROM tok WHERE length(token) > 1 GROUP BY 1, 2), sizes AS (SELECT path, sum(tf)::BIGINT AS n_tokens FROM post GROUP BY 1)"


def _occurrence(hay: str, needle: str, weight: float) -> str:
    at = f"(strpos({hay}, '{needle}') - 1)"
    return rf"""CASE WHEN {at} < 0 THEN 0.0 ELSE {weight} - {at} + CASE WHEN {at} = 0 THEN {0.6 * weight} WHEN regexp_matches(substr({hay}, {at}, 1), '[^a-z0-9]') THEN {0.35 * weight} ELSE 0.0 END + CASE WHEN {hay} = '{needle}' THEN {1.2 * weight} ELSE 0.0 END END"""


def _fuzzy(p: str, table: str, key: str, hay: str, needle: str) -> str:
    """Common tables, the last of them p_z of k and score: one pair a letter, each takes the first place after the last."""
    out = [f"{p}_0 AS (SELECT {key} AS k, {hay} AS raw, lower({hay}) AS low, 0 AS pos_, 0 AS first_, 0 AS run, 0.0 AS score, false AS lost FROM {table})"]
    for n, c in enumerate(needle, 1):
        found = f"(CASE WHEN strpos(substr(low, pos_ + 1), '{c}') = 0 THEN 0 ELSE strpos(substr(low, pos_ + 1), '{c}') + pos_ END)"
        out.append(f"{p}_g{n} AS (SELECT *, {found} AS now_ FROM {p}_{n - 1}), {p}_h{n} AS (SELECT *, CASE WHEN first_ > 0 AND now_ = pos_ + 1 THEN run + 1 ELSE 0 END AS run2 FROM {p}_g{n})")
        out.append(f"""{p}_{n} AS (SELECT k, raw, low, now_ AS pos_, CASE WHEN first_ > 0 THEN first_ ELSE now_ END AS first_, run2 AS run,
            score + 10 + 6 * run2 + CASE WHEN now_ = 1 THEN 14 WHEN now_ > 1 AND regexp_matches(substr(low, now_ - 1, 1), '[^a-z0-9]') THEN 12 WHEN now_ > 1 AND regexp_matches(substr(raw, now_ - 1, 1), '[a-z0-9]') AND regexp_matches(substr(raw, now_, 1), '[A-Z]') THEN 10 ELSE 0 END AS score,
            lost OR now_ = 0 AS lost FROM {p}_h{n})""")
    return ", ".join(out) + f", {p}_z AS (SELECT k, CASE WHEN lost THEN 0.0 ELSE greatest(1.0, score - (first_ - 1) - 0.4 * greatest(length(raw) - {len(needle)}, 0)) END AS score FROM {p}_{len(needle)})"


def _content(phrases: tuple[str, ...], terms: tuple[str, ...]) -> str:
    every = " AND ".join(f"contains(lower(text), '{w}')" for w in (*phrases, *terms))
    total = " + ".join([_occurrence("lower(text)", p, 120.0) for p in phrases] + [_occurrence("lower(text)", t, 60.0) for t in terms])
    return f"CASE WHEN {every} THEN {total} ELSE 0.0 END"


_NAME = "split_part(lower(path), '/', -1)"
_BASE = "split_part(path, '/', -1)"


def _term(t: str, name: str, path: str) -> str:
    """The score of a term by path; name and path are the tables of its scores as a subsequence."""
    return f"""CASE WHEN {_NAME} = '{t}' THEN 320.0 ELSE coalesce(nullif({_occurrence(_NAME, t, 150.0)}, 0), nullif({_occurrence('lower(path)', t, 70.0)}, 0), nullif({name}.score, 0), {path}.score) END"""


_RAW = "p_name || ' \"' || p_type || ' Part ' || p_size || '\"  -' || p_brand || ' EXT:JS,.ts,, path:' || p_brand || ' kind:Class is:' || CASE WHEN p_size % 2 = 0 THEN 'Tests' ELSE 'other' END || ' /P' || p_size || '.*/' || CASE WHEN p_size % 3 = 0 THEN 'gi' ELSE '' END || ' in: \"\" u:' || p_size || ' -'"


def _first(*words: str) -> str:
    """The first place of any of the words (quoted) in the text in lower case, or zero."""
    return "coalesce(least(" + ", ".join(f"nullif(strpos(lower(text), {w}), 0)" for w in words) + "), 0)"


def _line(at: str) -> str:
    return f"(CASE WHEN {at} <= 1 THEN 1 ELSE length(left(text, {at} - 1)) - length(replace(left(text, {at} - 1), chr(10), '')) + 1 END)::BIGINT"


def _snippet(at: str, most: int) -> str:
    before = f"string_split(left(text, {at} - 1), chr(10))[-1]"
    whole = f"regexp_replace({before} || string_split(substr(text, {at}), chr(10))[1], '\\r$', '')"
    begin = f"greatest(length({before}) - {most // 3}, 0)"
    return f"trim(CASE WHEN length({whole}) > {most} THEN CASE WHEN {begin} > 0 THEN '…' ELSE '' END || substr({whole}, {begin} + 1, {most - 2}) ELSE {whole} END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


#: Answers to the third query: a path that has no score of its own may answer by its text.
_THREE = ", ".join([_fuzzy("u", "files", "path", _BASE, "that"), _fuzzy("v", "files", "path", "path", "that")]) + f""",
        cand AS (SELECT files.path, text, {_term("that", "u_z", "v_z")} AS own, contains(lower(path), 'the') AND regexp_matches(path, '(?i)ing\\b') AS met FROM files JOIN u_z ON u_z.k = path JOIN v_z ON v_z.k = path WHERE NOT contains(path, 'tests') AND (path LIKE '%.js' OR path LIKE '%.ts')),
        every3 AS (SELECT path, text, round({_occurrence("lower(text)", "the", 120.0)} + 100.0 + {_occurrence("lower(text)", "that", 60.0)}, 4) AS score, least(strpos(lower(text), 'the'), strpos(lower(text), 'that'), nullif(strpos(text, regexp_extract(text, '(?i)ing\\b')), 0)) AS pos_
          FROM cand WHERE NOT met AND contains(lower(text), 'the') AND contains(lower(text), 'that') AND regexp_matches(text, '(?i)ing\\b')), """

ORACLES = {
    "q_index": _P + "SELECT path, token, tf, n_tokens FROM post JOIN sizes USING (path)",
    "q_tfidf": _P + """, h AS (SELECT * FROM post WHERE token IN ('the', 'license', 'idiot')), d AS (SELECT token, count(*) AS df FROM h GROUP BY 1)
        SELECT path, round(sum(tf / sqrt(n_tokens) * ln(1 + (SELECT count(*) FROM files) / df)) * count(*) / 3, 6) AS score FROM h JOIN d USING (token) JOIN sizes USING (path) GROUP BY 1 ORDER BY score DESC, path LIMIT 10""",
    "q_score_path": "WITH " + B.FILES + ", " + ", ".join(_fuzzy(p, "files", "path", h, t) for p, h, t in (("a", _BASE, "doc_1"), ("b", "path", "doc_1"), ("c", _BASE, "src1"), ("d", "path", "src1"))) + f""",
        s AS (SELECT path, {_term("doc_1", "a_z", "b_z")} AS x, {_term("src1", "c_z", "d_z")} AS y FROM files JOIN a_z ON a_z.k = path JOIN b_z ON b_z.k = path JOIN c_z ON c_z.k = path JOIN d_z ON d_z.k = path)
        SELECT path, round(CASE WHEN x = 0 OR y = 0 THEN 0.0 WHEN x + y - 0.5 * len(string_split(path, '/')) > 0 THEN x + y - 0.5 * len(string_split(path, '/')) ELSE 0.5 END, 4)::DOUBLE AS score FROM s""",
    "q_score_content": "WITH " + B.FILES + f"SELECT * FROM (SELECT path, round({_content((' the ',), ('and', 'that'))}, 4)::DOUBLE AS score FROM files) WHERE score <> 0",
    "q_score_symbol": "WITH " + _fuzzy("a", "part", "p_partkey", "p_name", "ring") + f""" SELECT p_partkey, round(CASE WHEN (contains(lower(p_type), 'economy') OR contains(lower(p_type), 'small') OR lower(p_name) LIKE '%economy' OR lower(p_name) LIKE '%small') AND NOT contains(lower(p_name), 'red')
        THEN CASE WHEN lower(p_name) = 'ring' THEN 240.0 ELSE coalesce(nullif({_occurrence('lower(p_name)', 'ring', 130.0)}, 0), a_z.score) END ELSE 0.0 END, 4)::DOUBLE AS score FROM part JOIN a_z ON k = p_partkey""",
    "q_strict": "WITH " + B.FILES + f""", s AS (SELECT path, round({_occurrence(_NAME, "s", 150.0)} - 0.5 * len(string_split(path, '/')), 4)::DOUBLE AS path_score, round({_content((), ('s',))}, 4)::DOUBLE AS content_score FROM files WHERE path LIKE '%.js' AND NOT contains(path, '/tests/'))
        SELECT path, path_score, content_score, round(path_score + content_score, 4) AS score FROM s WHERE path_score <> 0 OR content_score <> 0 ORDER BY score DESC, path LIMIT 50""",
    "q_fuzzy": "WITH named AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS n FROM part), " + _fuzzy("a", "named", "p_partkey", "n", "rng") + " SELECT k AS p_partkey, round(score, 4)::DOUBLE AS score FROM a_z",
    "q_occurrence": f"SELECT p_partkey, round({_occurrence('lower(p_name)', 'r', 100.0)}, 4)::DOUBLE AS score FROM part",
    "q_parse": f"""WITH r AS (SELECT *, {_RAW} AS raw FROM part)
        SELECT p_partkey, array_to_string(list_concat(string_split(lower(p_name), ' '), CASE WHEN p_size % 2 = 0 THEN [] ELSE ['is:other'] END, ['u:' || p_size, '-']), '|') AS term, lower(p_type) || ' part ' || p_size AS phrase, lower(p_brand) AS neg, 'js|ts' AS ext,
          lower(p_brand) AS path, 'class' AS kind, CASE WHEN p_size % 2 = 0 THEN 'test' ELSE '' END AS "is", 'P' || p_size || '.*' AS regex, CASE WHEN p_size % 3 = 0 THEN 'gi' ELSE 'i' END AS flags, (len(string_split(p_name, ' ')) + 9)::BIGINT AS n, true AS spans FROM r""",
    "q_remove_clause": f"""WITH r AS (SELECT *, {_RAW} AS raw FROM part) SELECT p_partkey, split_part(p_name, ' ', 1) || CASE WHEN len(string_split(p_name, ' ')) > 2 THEN ' ' || array_to_string(string_split(p_name, ' ')[3:], ' ') ELSE '' END || substr(raw, length(p_name) + 1) AS second,
        raw[:-3] AS "last", regexp_replace(raw[:5], '\\s+$', '') || ' ' || regexp_replace(raw[6:], '^\\s+', '') AS "none" FROM r""",
    "q_flags": "SELECT p_partkey, p_size % 4 = 0 AS \"empty\", p_size % 4 = 2 AS filters, p_size % 4 >= 2 AS advanced FROM part",
    "q_dispatch": "WITH " + B.FILES + f""", tok AS (SELECT path, unnest(regexp_split_to_array(lower(text), '\\W+')) AS token FROM files), post AS (SELECT path, token, count(*) AS tf FROM tok WHERE length(token) > 1 GROUP BY 1, 2), sizes AS (SELECT path, sum(tf)::BIGINT AS n_tokens FROM post GROUP BY 1),
        h AS (SELECT * FROM post WHERE token IN ('the', 'license')), d AS (SELECT token, count(*) AS df FROM h GROUP BY 1), one AS (SELECT path, round(round(sum(tf / sqrt(n_tokens) * ln(1 + (SELECT count(*) FROM files) / df)) * count(*) / 2, 6), 4) AS score FROM h JOIN d USING (token) JOIN sizes USING (path) GROUP BY 1 ORDER BY round(sum(tf / sqrt(n_tokens) * ln(1 + (SELECT count(*) FROM files) / df)) * count(*) / 2, 6) DESC, path LIMIT 20),
        o AS (SELECT 0 AS k, path, score, text, {_first("'the'", "'license'")} AS pos_ FROM one JOIN files USING (path)),
        o2 AS (SELECT *, trim(string_split(text, chr(10))[length(left(text, pos_ - 1)) - length(replace(left(text, pos_ - 1), chr(10), '')) + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS whole FROM o),
        two AS (SELECT 1 AS k, path, 1.0 AS score, text, 0 AS pos_ FROM files WHERE contains(path, 'src1') AND path LIKE '%.py' AND contains(path, '/tests/') ORDER BY path LIMIT 20), {_THREE}
        three AS (SELECT 2 AS k, path, round(score, 4) AS score, text, pos_ FROM every3 WHERE score <> 0 ORDER BY round(score, 4) DESC, path LIMIT 20)
        SELECT k, path, score::DOUBLE AS score, CASE WHEN pos_ = 0 THEN 1 ELSE length(left(text, pos_ - 1)) - length(replace(left(text, pos_ - 1), chr(10), '')) + 1 END::BIGINT AS line, CASE WHEN pos_ = 0 THEN '' WHEN length(whole) > 120 THEN left(whole, 117) || '…' ELSE whole END AS snippet FROM o2
        UNION ALL SELECT k, path, score::DOUBLE, {_line("pos_")}, {_snippet("greatest(pos_, 1)", 120)} FROM (SELECT * FROM two UNION ALL SELECT * FROM three)""",
    "q_total": "WITH " + B.FILES + f""", {_THREE} t AS (SELECT 1) SELECT 0 AS k, 0::BIGINT AS total UNION ALL SELECT 1, count(*) FROM files WHERE contains(path, 'src1') AND path LIKE '%.py' AND contains(path, '/tests/') UNION ALL SELECT 2, count(*) FROM every3 WHERE score <> 0""",
    "q_symbols": "WITH " + K.statements_sql() + """, s AS (SELECT path, name AS symbol, CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 ELSE 2 END AS r, line, CASE kind WHEN 'function' THEN name || '()' ELSE name END AS name, CASE kind WHEN 'class' THEN 'class' WHEN 'function' THEN detail ELSE 'export ' || detail END AS kind
          FROM found WHERE lang = 'javascript' AND kind IN ('class', 'function', 'export'))
        SELECT path, name, symbol, kind, CASE WHEN r < 2 THEN line ELSE 0 END::BIGINT AS line FROM s QUALIFY row_number() OVER (PARTITION BY path, symbol ORDER BY r, line) = 1""",
    "q_palette": "WITH " + K.statements_sql() + f""", f AS (SELECT DISTINCT path FROM p WHERE contains(path, 'd1') AND path LIKE '%.js'), s AS (SELECT path, name, lower(name || CASE kind WHEN 'function' THEN '()' ELSE '' END) AS low, CASE WHEN kind = 'function' THEN name || '()' ELSE name END AS shown, line FROM found WHERE lang = 'javascript' AND kind = 'function')
        SELECT 'symbol' AS type, path, shown AS name, round({_occurrence("low", "wrap", 130.0)}, 4)::DOUBLE AS score, line::BIGINT AS line FROM s JOIN f USING (path) WHERE contains(low, 'wrap')""",
    "snippet_at": "WITH " + B.FILES + f", x AS (SELECT path, text, strpos(lower(text), 'and') AS pos_ FROM files) SELECT path, {_line('pos_')} AS line, {_snippet('greatest(pos_, 1)', 60)} AS snippet FROM x",
    "highlight_pattern": """WITH c AS (SELECT p_partkey, unnest(range(length(p_name))) AS i, p_name AS x FROM part), m AS (SELECT p_partkey, i FROM c WHERE substr(x, i + 1, 1) IN ('e', 'f', 'g', 'z') OR substr(x, i + 1, 2) = 'ri' OR (i > 0 AND substr(x, i, 2) = 'ed')),
        g AS (SELECT p_partkey, i, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS grp FROM m), r AS (SELECT p_partkey, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY p_partkey, grp)
        SELECT p_partkey, coalesce(string_agg(a || '-' || b, ',' ORDER BY a), '') AS marks FROM part LEFT JOIN r USING (p_partkey) GROUP BY 1""",
    "highlight": """WITH c AS (SELECT p_partkey, unnest(range(length(p_name))) AS i, lower(p_name) AS x FROM part), m AS (SELECT p_partkey, i FROM c WHERE substr(x, i + 1, 1) IN ('e', 'r')),
        g AS (SELECT p_partkey, i, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS grp FROM m)
        SELECT p.p_partkey, count(DISTINCT grp) AS ranges, count(i) AS marked, coalesce(min(i), -1)::BIGINT AS "first" FROM part p LEFT JOIN g USING (p_partkey) GROUP BY 1""",
}
