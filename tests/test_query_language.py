"""The search language: clauses and their places, gates, marks, snippets, and which way a query is answered."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import code as C
from sparkloom.operators import search as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def clauses(spark, raw, case=False):
    p = one(spark, S.parse(F.lit(raw), case).alias("p")).p
    assert all(raw[c.start : c.end] == c.raw for c in p.clauses)
    return [(c.kind, c.value) for c in p.clauses], p.error


def test_clauses(spark):
    assert clauses(spark, 'OpenFile Reader') == ([("term", "openfile"), ("term", "reader")], None)
    assert clauses(spark, '"Two Words" more ""  " "') == ([("phrase", "two words"), ("term", "more")], None)
    assert clauses(spark, "EXT:.JS,ts, type:py in:A/b PATH:c kind:Class is:tests is:SRC is:odd -Skip - -a:b") == (
        [("ext", ".js,ts,"), ("ext", "py"), ("path", "a/b"), ("path", "c"), ("kind", "class"), ("is", "test"), ("is", "source"), ("term", "is:odd"), ("neg", "skip"), ("term", "-"), ("neg", "a:b")], None,
    )
    assert clauses(spark, "https://x.org ext: :y Read:") == ([("term", "https://x.org"), ("term", ":y")], None)
    assert clauses(spark, "/a/b /c/ d/e /f g/") == ([("regex", "a"), ("term", "b"), ("regex", "c"), ("term", "d/e"), ("term", "/f"), ("term", "g/")], None)
    assert clauses(spark, "Aa -Bb path:Cc \"Dd\" kind:Ee", True)[0] == [("term", "Aa"), ("neg", "Bb"), ("path", "Cc"), ("phrase", "Dd"), ("kind", "ee")]
    assert clauses(spark, "x /" + "a" * 201 + "/ y") == ([("term", "x"), ("term", "y")], "Regex is too long (201 > 200).")
    assert clauses(spark, "/" + "a" * 200 + "/")[1] is None and clauses(spark, "") == clauses(spark, " \n") == ([], None)
    assert one(spark, S.parse(F.lit(None).cast("string")).alias("p")).p.clauses == []


def test_compiled(spark):
    q = S.compiled(spark, 'Word "A b" /x.y/ ext:js,.TS kind:fn is:test -no path:p')
    assert q == S.Query(("word",), ("a b",), "(?i)x.y", ("no",), ("fn",), ("js", "ts"), ("p",), True) and q.filters and q.advanced and not q.empty and not q.error
    assert S.compiled(spark, "/X/").pattern == "(?i)X" and S.compiled(spark, "/X/", True).pattern == "X" and S.compiled(spark, "/X/gsi", True).pattern == "(?s)(?i)X"
    bad = S.compiled(spark, "/[open/")
    assert bad.pattern == "" and bad.error.startswith("Bad regex") and "too long" in S.compiled(spark, "/" + "b" * 300 + "/").error
    assert not S.compiled(spark, "plain words").advanced and S.compiled(spark, "plain", True).advanced and S.compiled(spark, "  ").empty


def test_kinds_of_queries(spark):
    of = lambda raw, case=False: tuple(one(spark, S.flags(S.parse(F.lit(raw)), case).alias("f")).f)
    assert of("") == of(" ") == of("ext:,") == (True, False, False) and of("word") == (False, False, False) and of("word", True) == (False, False, True)
    assert of("ext:js") == of("is:test") == of("-x") == (False, True, True) and of('"a b"') == of("/a/") == (False, False, True)


def test_removal(spark):
    raw = '  ext:js  "exact one" -vendor path:server   render'
    spans = {c.kind: c for c in one(spark, S.parse(F.lit(raw)).alias("p")).p.clauses}
    cut = lambda c: one(spark, S.without_clause(F.lit(raw), F.lit(c.start), F.lit(c.end)).alias("x")).x
    assert cut(spans["ext"]) == '"exact one" -vendor path:server   render' and cut(spans["term"]) == '  ext:js  "exact one" -vendor path:server'
    assert cut(spans["phrase"]) == "  ext:js -vendor path:server   render"
    assert one(spark, S.without_clause(F.lit("ext:js"), F.lit(0), F.lit(6)).alias("x")).x == "" and one(spark, S.without_clause(F.lit("ab"), F.lit(9), F.lit(3)).alias("x")).x == "ab"


@pytest.mark.parametrize("raw, case, passes", [
    ("ext:js", False, {"server/apiSearch.js", "tests/a.test.js", "src/vendor.js", "vendor/lib.js"}), ("ext:ts,py", False, {"src/app.ts", "b/__tests__/c.py"}),
    ("path:SERVER", False, {"server/apiSearch.js"}), ("path:API", True, set()), ("is:test", False, {"tests/a.test.js", "b/__tests__/c.py"}),
    ("is:source -vendor ext:js", False, {"server/apiSearch.js"}), ("kind:class", False, None), ("", False, None),
])
def test_gates(spark, raw, case, passes):
    paths = ["server/apiSearch.js", "src/app.ts", "Makefile", "tests/a.test.js", "src/vendor.js", "vendor/lib.js", "b/__tests__/c.py", "src/contest.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p for r in df.where(S.gate(F.col("p"), S.compiled(spark, raw, case))).collect()} == (set(paths) if passes is None else passes)


def test_case(spark):
    hits = lambda raw, case: one(spark, S.content_score(F.lit("Alpha beta"), S.compiled(spark, raw, case)).alias("s"), S.path_score(F.lit("src/Alpha.js"), S.compiled(spark, raw, case)).alias("p"))
    assert hits("alpha", False).s > 0 and hits("alpha", True).s == 0 and hits("Alpha", True).s > 0
    assert hits("ALPHA.js", True).p == 0 and hits("Alpha.js", True).p == 319.0 and hits("AJS", False).p > 0 and hits("/alpha/", True).p == 0


def marks(spark, text, raw, case=False):
    return [tuple(r) for r in one(spark, S.highlight(F.lit(text), S.compiled(spark, raw, case)).alias("m")).m]


def test_marks(spark):
    assert marks(spark, "a openFile b openFile", "openfile") == [(2, 10), (13, 21)] and marks(spark, "abc", "abc bc") == [(0, 3)]
    assert marks(spark, "Alpha alpha", "alpha", True) == [(6, 11)] and marks(spark, "the exact one here", '"exact one"') == [(4, 13)]
    assert marks(spark, "abc", "/x*/") == [] and marks(spark, "axbxc", "/x/") == [(1, 2), (3, 4)] and marks(spark, "abc abc", "/b+/") == [(1, 2), (5, 6)]
    assert marks(spark, "foobar", "/o(?=b)/ foo") == [(0, 3)] and marks(spark, "a.b a+b", "a.b a+b") == [(0, 3), (4, 7)] and marks(spark, "", "x") == marks(spark, "x", "ext:js") == []
    assert len(marks(spark, "x y " * 1000, "x")) == 400 and marks(spark, "﷐x﷑", "x") == [(1, 2)] and marks(spark, "a$1\\", "$1\\") == [(1, 4)]


def test_snippets(spark):
    text = "aaa\n  const x = open(1);\r\n" + "y" * 300 + "NEEDLE" + "z" * 300
    at = lambda n, most=120: tuple(one(spark, S.line_at(F.lit(text), F.lit(n)).alias("l"), S.snippet_at(F.lit(text), F.lit(n), most).alias("s")))
    assert at(0) == at(1) == at(-3) == (1, "aaa") and at(text.index("open") + 1) == (2, "const x = open(1);")
    line, shown = at(text.index("NEEDLE") + 1, 60)
    assert line == 3 and "NEEDLE" in shown and len(shown) <= 60 and shown.startswith("…")


def test_snippet_keeps_the_hit(spark):
    text = "a" * 300 + "hit" + "b" * 300
    row = one(spark, C.snippet(F.lit(text), "hit").alias("s"), C.snippet(F.lit(text), "none").alias("n"))
    assert "hit" in row.s and row.s.startswith("…") and len(row.s) <= 120 and row.n == ""


DOCS = [
    ("src/router.js", "export function openRouter() {\n  return config;\n}\n"), ("src/server.py", "# openRouter is not here\nopenRouter()\n"),
    ("tests/router.test.js", "import { openRouter } from '../src/router.js';\n// openRouter test\n"), ("vendor/lib.js", "module.exports = { openRouter: true };\n"), ("README.md", "nothing"),
]


def test_answers(spark):
    docs = spark.createDataFrame(DOCS, "path string, text string")
    ask = lambda raw, most=15: [(r.path, r.line) for r in S.search(docs, S.compiled(spark, raw), most).collect()]
    total = lambda raw: S.search_total(docs, S.compiled(spark, raw)).first().total
    assert {p for p, _ in ask("openRouter")} == {d[0] for d in DOCS[:4]} and {p for p, _ in ask("openRouter nothing")} == {d[0] for d in DOCS}
    assert {p for p, _ in ask("openRouter ext:js")} == {"src/router.js", "tests/router.test.js", "vendor/lib.js"} and ask("openRouter is:test") == [("tests/router.test.js", 1)]
    assert "vendor/lib.js" not in {p for p, _ in ask("openRouter -vendor")} and ask('"return config"') == [("src/router.js", 2)]
    assert [p for p, _ in ask("ext:js")] == ["src/router.js", "tests/router.test.js", "vendor/lib.js"] and len(ask("ext:js", 2)) == 2 and total("ext:js") == 3
    assert ask("/[oops/") == ask("kind:class") == ask("  ") == [] and total("kind:class") == total("/[oops/") == 0 and ask("kind:class router.js")[0][0] == "src/router.js"
    assert S.search(docs.limit(0), S.compiled(spark, "x"), 5).count() == S.search(docs.limit(0), S.compiled(spark, "ext:js"), 5).count() == 0


def test_symbols_and_palette(spark):
    from sparkloom.operators import symbols as Y

    files = spark.createDataFrame([("a.js", "javascript", "export function run() {}\nexport class Box {}\nexport const size = 1\nfunction Box2() {}\n"), ("b.py", "python", "class Run: pass\n")], "path string, lang string, text string")
    found = S.symbols_of(Y.extract(files))
    assert {tuple(r) for r in found.collect()} == {("a.js", "run()", "run", "function", 1), ("a.js", "Box", "Box", "class", 2), ("a.js", "size", "size", "export const", None), ("a.js", "Box2()", "Box2", "function", 4), ("b.py", "Run", "Run", "class", 1)}
    ask = lambda raw: {(r.type, r.path, r.name) for r in S.palette(files, found, S.compiled(spark, raw)).collect()}
    assert ask("run") == {("symbol", "a.js", "run()"), ("symbol", "b.py", "Run")} and ask("kind:class ext:js") == {("file", "a.js", ""), ("symbol", "a.js", "Box")} and ask("") == set()


def test_masks_bodies_calls(spark):
    mask = lambda x: one(spark, C.js_code_mask(F.lit(x)).alias("m")).m
    assert mask("a 'b\\'c' d // e\nf /* g\nh */ i `j${k}` \"l\" m") == "a        d     \nf     \n     i         " + "    m" and mask("x = 'open") == "x =      " and mask("") == "" and mask("a / b") == "a / b"
    text = "x" * 9000 + "'" + "y" * 9000 + "\\'" * 500 + "' z"
    assert mask(text) == "x" * 9000 + " " * (len(text) - 9002) + " z"
    body = lambda x, k: one(spark, C.brace_body(F.lit(x), F.lit(k)).alias("b")).b
    assert body("f() { a { b } c } d }", 5) == "{ a { b } c }" and body("{ a {", 1) == "{ a {" and body("{}", 1) == "{}"
    calls = lambda x, *n: one(spark, C.calls_within(F.lit(x), F.array(*map(F.lit, n))).alias("c")).c
    assert calls("b( a (x) o.c() $d() bb() ", "a", "b", "c", "d", "e") == ["a", "b", "c"] and one(spark, C.declaration_order(F.array(F.lit("z"), F.lit("a")), F.array(F.lit("a"), F.lit("m"), F.lit("z"))).alias("o")).o == ["a", "z"]
