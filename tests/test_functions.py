"""Scalar functions on small vectors."""

import pytest
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom.functions import code as C
from sparkloom.functions import paths as P
from sparkloom.operators import findings as R
from sparkloom.operators import history as H
from sparkloom.operators import search as S


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("v")).first().v


@pytest.mark.parametrize("path,test", [("foo.test.js", True), ("a_spec.rb", True), ("tests/foo.py", True), ("__tests__/x.jsx", True), ("contest.js", False), ("latest.md", False), ("a/protester.go", False)])
def test_test_paths(spark, path, test):
    assert value(spark, P.is_test(F.col("p")), p=path) is test


def test_paths(spark):
    get = lambda f, p: value(spark, f(F.col("p")), p=p)
    assert get(P.normalize, "./a/../../b//c/.") == "b/c"
    assert get(P.ext_of, "x/.eslintrc") == "" and get(P.ext_of, "a.b/C.Min.JS") == ".js" and get(P.ext_of, "a.d/Makefile") == ""
    assert get(P.dir_of, "a") == "" and get(P.dir_of, "a/b/c") == "a/b" and get(P.top_folder, "x") == "(root)"
    assert get(P.language_of, "q.tsx") == "typescript" and get(P.language_of, "q.md") is None
    assert get(P.ancestors, "a/b/c.js") == ["", "a", "a/b"]


def test_code_stats(spark):
    text = "// hello\n\nconst x = 1\n/* a\n b */\nconst y"
    s = value(spark, C.code_stats(F.col("t"), F.lit("javascript")), t=text)
    assert (s.lines, s.code, s.comment, s.blank) == (6, 2, 3, 1)
    s = value(spark, C.code_stats(F.col("t"), F.lit("python")), t="# c\nx\n")
    assert (s.code, s.comment, s.blank) == (1, 1, 1)


def test_metrics(spark):
    of = lambda f, t, lang: value(spark, f(F.col("t"), F.lit(lang)), t=t)
    assert of(C.complexity, "const a = 1;", "javascript") == 1
    assert of(C.complexity, "if a:\n  b\nelif c:\n  d", "python") == 3
    assert of(C.complexity, "// if for while\na ? b : c && d", "javascript") == 3
    assert of(C.cognitive, "if (a) {\n  for (b) {\n  }\n}\nelse {\n}", "javascript") == 1 + 2 + 1
    h = of(C.halstead, "a = b + b", "javascript")
    assert (h.n1, h.n2, h.t1, h.t2) == (2, 2, 2, 3)
    assert value(spark, C.maintainability(F.lit(0.0), F.lit(1), F.col("n")), n=5) == 100.0


def test_text(spark):
    page = "<title> A <b>x</b></title><script>if (a<b) {}</script><p>one &amp;lt; two&nbsp;three</p>\n\n\n<p>four"
    assert value(spark, C.html_text(F.col("t")), t=page) == "A x one &lt; two three\n\nfour"
    assert value(spark, C.clean_version(F.col("t")), t="^~>= 1.2.3 beta") == "1.2.3"
    assert value(spark, C.mermaid_text(F.col("t")), t='a["b"] & <c>') == "ab and c"
    assert value(spark, C.line_of(F.col("t"), "z"), t="a\nb z") == 2 and value(spark, C.snippet(F.col("t"), "z"), t="a\n  b z ") == "b z"


@pytest.mark.parametrize("lang,line,rule", [
    ("javascript", "const password = 'hunter2hunter2'", "hardcoded-secret"), ("python", "yaml.load(x)", "insecure-deser"), ("javascript", "el.innerHTML = x", "innerhtml"), ("go", 'http.ListenAndServe(":80", nil)', "go-public-listen"),
])
def test_rules_hit(spark, lang, line, rule):
    df = spark.createDataFrame([("f", "x\n" + line, lang)], "path string, text string, lang string")
    assert rule in {r.rule for r in R.scan(df).where("line = 2").collect()}


@pytest.mark.parametrize("lang,line,rule", [("python", "yaml.load(x, SafeLoader)", "insecure-deser"), ("javascript", "el.innerHTML = '';", "innerhtml"), ("typescript", "eval(x)", "eval")])
def test_rules_miss(spark, lang, line, rule):
    df = spark.createDataFrame([("f", line, lang)], "path string, text string, lang string")
    assert rule not in {r.rule for r in R.scan(df).collect()}


def test_plain_texts_hide_no_match(spark, monkeypatch):
    """The search for plain texts before the patterns loses no finding; every rule hits a line at least."""
    rows = [(f"f{k}", x, g) for k, (_, g, x) in enumerate(B.CODE)] + [("m", "write to a.b@c.de", "go"), ("l", "Licensed under X", "go")] + [(f"u{k}", x.upper(), g) for k, (_, g, x) in enumerate(B.CODE)]
    df = spark.createDataFrame(rows, "path string, text string, lang string")
    found = sorted((r.path, r.rule) for r in R.scan(df, extra=R.CORPUS_RULES).collect())
    assert {r for _, r in found} == {r.id for r in (*R.RULES, *R.CORPUS_RULES)} == set(R.NEEDS)
    monkeypatch.setattr(R, "NEEDS", {})
    assert found == sorted((r.path, r.rule) for r in R.scan(df, extra=R.CORPUS_RULES).collect())


def test_licences(spark):
    assert value(spark, R.licence_of(F.col("t")), t="GNU GENERAL PUBLIC LICENSE\n Version 3") == "GPL-3.0"
    kinds = {k: value(spark, R.licence_kind(F.col("t")), t=k) for k in ("MIT", "LGPL-3.0", "AGPL-3.0", "", "Beer")}
    assert kinds == {"MIT": "permissive", "LGPL-3.0": "weak-copyleft", "AGPL-3.0": "copyleft", "": "unknown", "Beer": "custom"}


def test_history(spark):
    commits = spark.createDataFrame([(c, "x", "2024-01-01", p) for c, ps in ((1, "ab"), (2, "ab"), (3, "ac")) for p in ps], "commit long, author string, day string, path string")
    none = spark.createDataFrame([], "src string, dst string")
    assert [tuple(r) for r in H.cochange(commits, none).collect()] == [("a", "b", 2)]
    assert H.cochange(commits, spark.createDataFrame([("b", "a")], "src string, dst string")).count() == 0
    wide = spark.createDataFrame([(c, "x", "d", f"f{k}") for c in (1, 2) for k in range(51)], "commit long, author string, day string, path string")
    assert H.cochange(wide, none).count() == 0 and {r.churn for r in H.churn(wide).collect()} == {2}
    hot = H.hotspots(spark.createDataFrame([("a", 4), ("b", 1)], "path string, churn long"), spark.createDataFrame([("a", 10), ("b", 1), ("z", 9)], "path string, complexity long"))
    assert {r.path: r.hotspot for r in hot.collect()} == {"a": 100, "b": 3}


def test_fuzzy(spark):
    got = {w: value(spark, S.fuzzy(F.col("t"), "gh"), t=w) for w in ("gitHub", "ghost", "graph", "hg")}
    assert got["hg"] == 0 and got["gitHub"] > got["graph"] and got["ghost"] > 0


def test_comments_are_blanked_in_place(spark):
    text = "a(); /* one\n two\n three */ b();\nimport x from './y'; // tail\nz(); /**/ w(); / q"
    rows = [("javascript", text), ("python", "x = 1\n  # note\ny = 2 /* no */"), ("javascript", "// /* \n k(); */ m();"), ("go", "no comment"), ("go", ""), ("go", "/* open")]
    got = [r.c for r in spark.createDataFrame(rows, "lang string, text string").select(C.blank_comments(F.col("text"), F.col("lang")).alias("c")).collect()]
    assert [len(g) for g in got] == [len(t) for _, t in rows] and [g.count("\n") for g in got] == [t.count("\n") for _, t in rows]
    assert got[0].split("\n")[2] == "          b();" and got[0].split("\n")[3].rstrip() == "import x from './y';" and got[0].split("\n")[4] == "z();      w(); / q"
    assert got[1].split("\n") == ["x = 1", "        ", "y = 2         "] and got[2].endswith(" m();") and got[5] == "/* open"


def test_block_comments_are_carried(spark):
    rows = [("javascript", "/* a\n\nb */\nx();\n// y\n"), ("python", "# a\nx\n\n"), ("javascript", "x\n  // a\n\ty")]
    got = spark.createDataFrame(rows, "lang string, text string").select(C.code_stats(F.col("text"), F.col("lang")).alias("s")).select("s.*").collect()
    assert [(r.lines, r.code, r.comment, r.blank) for r in got] == [(6, 1, 3, 2), (4, 1, 1, 2), (3, 2, 1, 0)]
