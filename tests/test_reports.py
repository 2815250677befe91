"""Stacks, licences, remote facts, first contributions, sheets and further patterns on small fixtures."""

from pyspark.sql import functions as F

from sparkloom.operators import deps as D
from sparkloom.plans import reports as R
from sparkloom.plans import views as V


def test_stack(spark):
    rows = [
        ("react", "npm", "^18.2.0 x", False), ("react-dom", "npm", "^18", False), ("vite", "npm", "~5.0", True), ("left-pad", "npm", "1.0", False), ("django", "pip", "*", False), ("mine", "pip", "*", False),
        ("github.com/x/gin", "go", "*", False), ("github.com/x/own", "go", "*", False), ("actix_web", "cargo", "*", False), ("serde", "cargo", "*", False), ("react", "pip", "*", False),
    ]
    got = {r.name: (r.version, r.category, r.lang, r.docs, r.dev) for r in D.stack_items(spark.createDataFrame(rows, "label string, ecosystem string, version string, dev boolean")).collect()}
    assert got == {
        "react": ("18.2.0", "Frontend framework", "JavaScript", "https://react.dev", False), "vite": ("5.0", "Tooling / build", "JavaScript", "https://vitejs.dev/guide/", True), "left-pad": ("1.0", "Library", "JavaScript", "https://www.npmjs.com/package/left-pad", False),
        "django": ("", "Web framework", "Python", "https://docs.djangoproject.com", False), "mine": ("", "Library", "Python", "https://pypi.org/project/mine/", False), "github.com/x/gin": ("", "Web framework", "Go", "https://pkg.go.dev/github.com/x/gin", False),
        "github.com/x/own": ("", "Library", "Go", "https://pkg.go.dev/github.com/x/own", False), "actix_web": ("", "Web framework", "Rust", "https://actix.rs", False), "serde": ("", "Library", "Rust", "https://docs.rs/serde", False),
    }
    assert [r.category for r in D.stack_items(spark.createDataFrame(rows, "label string, ecosystem string, version string, dev boolean"), 4).collect()] == ["Web framework"] * 3 + ["Frontend framework"]


def test_hosts(spark):
    hosts = D.doc_hosts()
    assert len(hosts) == len(set(hosts)) and {"npmjs.com", "pypi.org", "pkg.go.dev", "docs.rs", "diesel.rs"} <= set(hosts) and not any(h.startswith("www.") for h in hosts)
    urls = {"https://www.npmjs.com/package/x": True, "https://docs.rs/a": True, "http://docs.rs/a": False, "https://evil.org/docs.rs": False, "https://docs.rs.evil.org/": False, "https://readthedocs.io": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.a for r in df.select("u", D.doc_allowed(F.col("u")).alias("a")).collect()} == urls


def test_project_licence(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, text string")
    said = lambda x: spark.createDataFrame([(x,)], "licence string")
    of = lambda rows, x: tuple(D.project_licence(files(rows), said(x)).first())
    assert of([("LICENSE.md", "GNU GENERAL PUBLIC LICENSE\n Version 3"), ("a/LICENSE", "MIT")], "MIT") == ("GPL-3.0", "copyleft", "LICENSE.md")
    assert of([("copying", "whatever")], "MIT") == ("Custom", "custom", "copying") and of([("a/LICENSE", "MIT")], "ISC") == ("ISC", "permissive", "manifest")
    assert of([], None) == ("UNKNOWN", "unknown", "") == tuple(D.project_licence(files([]), said("x").limit(0)).first())


def test_remote(spark):
    one = lambda text: spark.createDataFrame([(text,)], "t string").select(D.remote_facts(F.col("t")).alias("f")).first().f
    full = one('{"stargazers_count": 7, "forks_count": -1, "subscribers_count": 2.9, "description": " d ", "license": {"spdx_id": "MIT"}, "topics": ["a", "", "b"], "archived": true, "default_branch": "main"}')
    assert (full.stars, full.forks, full.watching, full.issues, full.description, full.licence, full.topics, full.archived, full.branch) == (7, 0, 2, 0, "d", "MIT", ["a", "b"], True, "main")
    assert one('{"license": {"spdx_id": "NOASSERTION"}}').licence == "" and one("[]") is None and one("null") is None
    said = [r.e for r in spark.createDataFrame([(s,) for s in (403, 404, 429, 500)], "s int").select(D.remote_error(F.col("s")).alias("e")).collect()]
    assert len(set(said)) == 4 and said[3] == "The host answered 500."


def repo(spark, paths, edges):
    return spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(edges, "src string, dst string")


def test_first_contribution(spark):
    files, edges = repo(spark, ["src/main.py", "src/core.py", "src/util.py", "README.md", "tests/test_core.py", "package.json", "logo.png"], [("src/main.py", "src/core.py"), ("src/util.py", "src/core.py"), ("tests/test_core.py", "src/main.py")])
    assert [(r.place, r.path, r.role) for r in R.trail(files, edges).orderBy("place").collect()] == [(1, "src/main.py", "entry"), (2, "src/core.py", "hub"), (3, "tests/test_core.py", "test"), (4, "README.md", "guide")]
    assert [tuple(r) for r in R.first_tasks(files, edges).collect()] == [(1, "trace the most imported file", "src/core.py", "2 files import it")]
    text = R.first_contribution(files, edges).first().text
    assert text.startswith("# First contribution\n\n7 files, 4 of source, 1 tests, 1 guides\n") and "- hub: `src/core.py`" in text and "1. trace the most imported file (`src/core.py`): 2 files import it\n" in text
    bare, none = repo(spark, ["a.py", "b.py"], [])
    assert [(r.place, r.task, r.path) for r in R.first_tasks(bare, none).collect()] == [(1, "write a quickstart", "a.py"), (2, "add a first test", "a.py"), (3, "write down what it runs on", "a.py")]
    assert R.trail(bare, none).count() == 0 == R.first_tasks(bare.limit(0).unionByName(spark.createDataFrame([("README.md",)], "path string")), none).count()


def test_sheets_and_views(spark):
    facts = spark.createDataFrame([(1, "a", "x", 2, 0, True, False), (2, "b", "x", 1, 2, False, False), (3, "c", "y", 0, 2, False, False)], "node long, name string, folder string, fan_out long, fan_in long, is_entry boolean, is_test boolean")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")
    traffic = spark.createDataFrame([("x", "y", 2)], "src_folder string, dst_folder string, n long")
    assert R.overview_sheet(facts, traffic).first().sheet == "Files by folder: x 2, y 1\nImports between folders: x to y 2\nEntries: 1\nMost imported: 2 2, 3 2"
    assert {r.folder: r.sheet for r in R.folder_sheets(facts, edges).collect()} == {"x": "x: 2 files\ninside: 1 to 2\noutward: 1 to 3; 2 to 3\ninward: none", "y": "y: 1 files\ninside: none\noutward: none\ninward: 1 to 3; 2 to 3"}
    assert {r.node: r.text for r in R.links_view(facts, edges).collect()}[2] == "b (module)\nimports 1: 3\nimported by 2: 1"
    commits = spark.createDataFrame([("c1", "a", "2024-01-01", "f"), ("c1", "a", "2024-01-01", "g"), ("c2", "b", "2024-01-02", None)], "commit string, author string, day string, path string")
    assert [tuple(r) for r in R.log_view(commits, 5).orderBy("place").collect()] == [(1, "c2", "b", "2024-01-02", 0), (2, "c1", "a", "2024-01-01", 2)]


def test_further_patterns(spark):
    facts = spark.createDataFrame([(k, k == 0, k == 9) for k in range(10)], "node long, is_entry boolean, is_test boolean")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (7, 8)], "src long, dst long")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = [
        frame([(4, 2), (6, 3)], "component long, size long"), frame([(5,)], "node long"), frame([("p", "f"), ("o", "g")], "path string, name string"), frame([("a", "undeclared"), ("b", "unused"), ("c", "unused")], "name string, drift string"),
        frame([("z", 4), ("y", 4), ("x", 2)], "name string, users long"), frame([("web",)], "name string"),
    ]
    got = {r.pattern: (r.severity, r.n, r.example) for r in V.further_patterns(facts, edges, *args).collect()}
    assert got == {
        "layered-shape": ("info", 4, ""), "unreachable": ("info", 6, "4"), "cycles": ("high", 2, "6"), "untested-hubs": ("high", 1, "5"), "dead-exports": ("low", 2, "o"), "undeclared-deps": ("high", 1, "a"),
        "unused-deps": ("low", 2, "b"), "top-external": ("info", 4, "y"), "services": ("info", 1, "web"),
    }
    empty = V.further_patterns(facts.where("node < 2").withColumn("is_test", F.lit(False)), edges.limit(0), *(a.limit(0) for a in args))
    assert {r.pattern for r in empty.collect()} == {"no-tests"}
