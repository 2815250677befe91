"""Readers and parsers on small fixtures."""

from pyspark.sql import functions as F

from sparkloom.operators import resolution as R
from sparkloom.operators import symbols as S
from sparkloom.sources import git, manifests, repository


def test_repository(spark, tmp_path):
    for name, text in {
        "app.js": "import './helper.js'\n", "helper.js": "export const x = 1", "README.md": "hi", "logo.png": "x", "yarn.lock": "x",
        "node_modules/dep/index.js": "x", "big.js": "y" * 500, "lib/a.min.js": "z", "bin.py": "a\0b", "gen/out.js": "k",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = repository.read(spark, str(tmp_path), 100, "# c\n/gen/\n!keep\n")
    got = {r.path: r.reason for r in files.collect()}
    assert got == {"app.js": None, "helper.js": None, "README.md": "notCode", "logo.png": "notSource", "yarn.lock": "notSource", "node_modules/dep/index.js": "vendorDir", "big.js": "tooLarge", "lib/a.min.js": "notSource", "bin.py": "binary", "gen/out.js": "ignored"}
    assert {r.reason: r.n for r in repository.counters(files).collect()}["parsed"] == 2
    assert [r.path for r in repository.truncated(files, 2).collect()] == ["README.md", "app.js"]


def test_ignore_pattern():
    import re

    rx = re.compile(repository.ignore_pattern("*.log\nbuild/\n/root.txt\na/**/z\n"))
    assert rx.search("x/y.log") and rx.search("q/build/f") and rx.search("root.txt") and rx.search("a/b/c/z")
    assert not rx.search("x/root.txt") and not rx.search("y.logs") and not rx.search("build")


def test_log(spark):
    text = "\x1eaaa\x1fx@y\x1fAnn\x1f2024-01-02\na.js\nb.js\n\x1ebbb\x1fz@y\x1fBob\x1f2024-01-03\n\nc.js\n"
    rows = git.parse_log(spark.createDataFrame([("r", text)], "repo string, text string")).orderBy("ord").collect()
    assert [(r.hash, r.author, r.day, r.files) for r in rows] == [("aaa", "x@y", "2024-01-02", ["a.js", "b.js"]), ("bbb", "z@y", "2024-01-03", ["c.js"])]


def test_diff(spark):
    text = "diff --git a/f.js b/f.js\nindex 1..2\n--- a/f.js\n+++ b/f.js\n@@ -10,4 +10,5 @@\n one\n-two\n+2\n+3\n four\ndiff --git a/g b/h\n@@ -1 +1 @@\n-x\n"
    diff = git.parse_diff(spark.createDataFrame([("r", text)], "repo string, text string"))
    assert [r.kind for r in diff.where("file_no = 1").orderBy("line_no").collect()] == ["ctx", "del", "add", "add", "ctx"]
    assert {r.new: (r.additions, r.deletions, r.hunks) for r in git.diff_stats(diff).collect()} == {"f.js": (2, 1, 1), "h": (0, 1, 1)}


def test_blame(spark):
    sha = "a" * 40
    text = f"{sha} 1 1 2\nauthor Ann\nauthor-time 1700000000\n\tfirst\n{sha} 2 2\n\tsecond\n"
    rows = git.parse_blame(spark.createDataFrame([("r", text)], "repo string, text string")).orderBy("line_no").collect()
    assert [(r.line_no, r.author, r.day, r.text) for r in rows] == [(1, "Ann", "2023-11-14", "first"), (2, "Ann", "2023-11-14", "second")]
    assert git.blame_authors(git.parse_blame(spark.createDataFrame([("r", text)], "repo string, text string"))).first().lines == 2


def test_manifests(spark):
    rows = [
        ("r", "package.json", '{"name":"p","dependencies":{"react":"^18.0.0 x"},"devDependencies":{"jest":"~29"}}'),
        ("r", "requirements.txt", "# c\nFlask==2\nnumpy>=1  # y\n-r other\n"), ("r", "go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire x.org/y v0.1.0\n"),
        ("r", "Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1"\n[dev-dependencies]\ntokio = { version = "1" }\n'),
    ]
    got = {(r.name, r.version, r.ecosystem, r.dev) for r in manifests.dependencies(spark.createDataFrame(rows, "repo string, file string, text string")).collect()}
    assert got == {("react", "18.0.0", "npm", False), ("jest", "29", "npm", True), ("flask", "*", "pip", False), ("numpy", "*", "pip", False), ("github.com/a/b", "*", "go", False), ("x.org/y", "*", "go", False), ("serde", "*", "cargo", False), ("tokio", "*", "cargo", False)}


def test_tool_reports(spark):
    one = lambda parse, text: spark.createDataFrame([(text,)], "t string").select(F.explode(parse(F.col("t"))).alias("f")).select("f.*").collect()
    assert one(manifests.semgrep, '{"results":[{"check_id":"r","path":"a.py","start":{"line":3},"extra":{"severity":"ERROR"}}]}')[0].severity == "high"
    assert one(manifests.gitleaks, '[{"RuleID":"k","File":"f","StartLine":2,"Secret":"s"}]')[0].rule == "k"
    assert [r.line for r in one(manifests.vulture, "a.py:1: unused x (90% confidence)\nb.py:2: unused y (40% confidence)\n")] == [1]
    assert [r.name for r in one(manifests.procfile, "web: node x\n# c\nworker: y\n")] == ["web", "worker"]


REPO = {
    "index.js": "import a from './a.js'\nimport { b } from './lib/b'\n// import './nope'\nconst f = (x) => x\nexport class K {}\n", "a.js": "const b = require('./lib/b.js')\nimport fs from 'fs'\nfunction go() {}\n",
    "lib/b.js": "export async function q() {}", "lib/c/index.js": "", "d.js": "import './lib/c'", "pkg/__init__.py": "", "pkg/m.py": "from . import n\nfrom .n import z\nimport os\nclass C:\n    def f(self):\n", "pkg/n.py": "import pkg.m\n",
}


def test_symbols_and_edges(spark):
    files = spark.createDataFrame([(p, t, {"js": "javascript", "py": "python"}[p.rsplit(".")[-1]]) for p, t in REPO.items()], "path string, text string, lang string")
    found = S.extract(files)
    assert {(r.path, r.line, r.name) for r in found.where("kind = 'function'").collect()} == {("index.js", 4, "f"), ("a.js", 3, "go"), ("lib/b.js", 1, "q"), ("pkg/m.py", 5, "f")}
    assert {r.name for r in found.where("kind = 'class'").collect()} == {"K", "C"}
    done = R.resolve(found, files)
    assert {(r.path, r.name) for r in done.where("target is null").collect()} == {("a.js", "fs"), ("pkg/m.py", "os")}
    assert {(r.src, r.dst) for r in R.edges(done).collect()} == {("index.js", "a.js"), ("index.js", "lib/b.js"), ("a.js", "lib/b.js"), ("d.js", "lib/c/index.js"), ("pkg/m.py", "pkg/__init__.py"), ("pkg/m.py", "pkg/n.py"), ("pkg/n.py", "pkg/m.py")}


def test_packages_and_dead_exports(spark):
    files = spark.createDataFrame([("x/a.go",), ("x/b.go",), ("main.go",)], "path string")
    imports = spark.createDataFrame([("main.go", "x"), ("x/a.go", "x")], "path string, package string")
    assert {(r.src, r.dst) for r in S.package_targets(imports, files).collect()} == {("main.go", "x/a.go"), ("main.go", "x/b.go"), ("x/a.go", "x/b.go")}
    exports = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "h"), ("c", "i"), ("e", "j")], "path string, name string")
    used = spark.createDataFrame([("a", "f"), ("b", "*")], "path string, name string")
    assert [(r.path, r.name) for r in S.dead_exports(exports, used, spark.createDataFrame([("c",)], "path string")).orderBy("path", "name").collect()] == [("a", "g"), ("e", "j")]


def test_directories_by_their_last_parts(spark):
    files = spark.createDataFrame([("a/b/c/d/f.cs",), ("a/b/c/d/g.cs",), ("x/c/d/h.cs",), ("d/i.cs",), (None,)], "path string")
    got = {(r.suffix, r.dir, r.n) for r in S.directories_by_suffix(files).collect()}
    assert got == {("d", "a/b/c/d", 3), ("c/d", "a/b/c/d", 2), ("b/c/d", "a/b/c/d", 1), ("x/c/d", "x/c/d", 1)}


def test_texts_of_one_repository_keep_apart(spark):
    one = "diff --git a/f b/f\n@@ -1 +1 @@\n-x\n+y\n"
    two = "diff --git a/g b/g\n@@ -1 +1 @@\n+z\n"
    diff = git.parse_diff(spark.createDataFrame([("r", one), ("r", two)], "repo string, text string"))
    assert sorted((r.new, r.file_no, r.kind) for r in diff.collect()) == [("f", 1, "add"), ("f", 1, "del"), ("g", 1, "add")]


def test_latest_commits_of_an_author(spark):
    rows = [("r", k, f"s{k % 12:02d}", "ann", f"2024-01-{k % 12 + 1:02d}", "x") for k in range(24)]
    got = git.blame_authors(spark.createDataFrame(rows, "repo string, line_no int, sha string, author string, day string, text string")).first()
    assert got.lines == 24 and list(got.latest) == [f"s{k:02d}" for k in range(11, 1, -1)] and (got.oldest, got.newest) == ("2024-01-01", "2024-01-12")


def test_equal_files_count_in_the_key(spark):
    key = lambda rows: spark.createDataFrame(rows, "path string, size long").agg(repository.cache_key()).first().key
    assert key([("a", 1), ("b", 2)]) == key([("b", 2), ("a", 1)]) != key([("a", 1), ("b", 2), ("a", 1), ("a", 1)])


def test_line_numbers_after_a_block_comment(spark):
    text = "/* one\ntwo\nthree */\nimport x from './y';\n"
    files = spark.createDataFrame([("a.js", "javascript", text)], "path string, lang string, text string")
    assert [(r.line, r.name) for r in S.extract(files).collect()] == [(4, "./y")]


def test_statuses_of_files(spark):
    text = "\n".join([
        "diff --git a/new.js b/new.js", "new file mode 100644", "@@ -0,0 +1,2 @@", "+a", "+b", "diff --git a/old.js b/old.js", "deleted file mode 100644", "@@ -1 +0,0 @@", "-x",
        "diff --git a/a.js b/lib/a.js", "similarity index 100%", "rename from a.js", "rename to lib/a.js", "diff --git a/m.js b/m.js", "--- a/m.js", "+++ b/m.js", "@@ -1 +1 @@", "-x", "+y", "@@ -9 +9 @@", "+z",
    ])
    rows = git.diff_files(spark.createDataFrame([("r", text)], "repo string, text string")).orderBy("file_no").collect()
    assert [(r.old, r.new, r.status, r.additions, r.deletions, r.hunks) for r in rows] == [
        ("new.js", "new.js", "added", 2, 0, 1), ("old.js", "old.js", "deleted", 0, 1, 1), ("a.js", "lib/a.js", "renamed", 0, 0, 0), ("m.js", "m.js", "modified", 2, 1, 2),
    ]
