"""Typed targets, documentation texts, payloads, logs in folders and tool reports on small fixtures."""

import json

from pyspark.sql import functions as F

from sparkloom.plans import agent as A
from sparkloom.plans import docs as D
from sparkloom.plans.targets import resolve_target
from sparkloom.sources import git, manifests, repository
from sparkloom.streaming import activity


def test_targets(spark):
    paths = ["server/logger.js", "src/a/index.js", "src/b/index.js", "src/b/Deep.ts", "lib/b/x.py", "README.md", "one/two/three.go"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")

    def ask(*typed):
        got = {}
        for r in resolve_target(spark.createDataFrame([(t,) for t in typed], "typed string"), files).collect():
            got.setdefault(r.typed, []).append((r.kind, r.path))
        return [sorted(got[t]) for t in typed]

    assert ask("server/logger.js", "./server/logger.js", "logger.js", "LOGGER.JS") == [[("file", "server/logger.js")]] * 4
    assert ask("src/b", "src/b/", "two", "one/two") == [[("folder", "src/b")], [("folder", "src/b")], [("folder", "one/two")], [("folder", "one/two")]]
    assert ask("index.js", "b/index.js", "deep.ts") == [[("which", "src/a/index.js"), ("which", "src/b/index.js")], [("file", "src/b/index.js")], [("file", "src/b/Deep.ts")]]
    assert ask("b") == [[("similar", p) for p in sorted(["lib/b/x.py", "src/b/Deep.ts", "src/b/index.js"])]]  # two folders end so: neither is meant
    assert ask("ee", "zzz", "a", ".", "./", " ", None)[1:] == [[("none", None)], [("folder", "src/a")], [("folder", "")], [("none", None)], [("none", None)], [("none", None)]]
    many = spark.createDataFrame([(f"x/{'y' * k}/file{k}.c",) for k in range(12)], "path string")
    got = resolve_target(spark.createDataFrame([("FILE",)], "typed string"), many).collect()
    assert len(got) == 8 and {r.kind for r in got} == {"similar"}
    assert [r.kind for r in resolve_target(spark.createDataFrame([("x",)], "typed string"), files.limit(0)).collect()] == ["none"]


FACTS = [(1, "main.js", "src", 3, 0, True, ["boot"]), (2, "hub.js", "src", 1, 6, False, list("abcdef")), (3, "leaf.js", "lib", 0, 1, False, []), (4, "lone.js", "lib", 0, 0, False, None), (5, "mid.js", "lib", 2, 2, False, ["x"]), (6, "top.js", "lib", 1, 0, False, [])]


def facts(spark):
    return spark.createDataFrame(FACTS, "node long, name string, folder string, fan_out long, fan_in long, is_entry boolean, functions array<string>")


def test_documentation(spark):
    f = facts(spark)
    assert {r.node: (r.role, r.functions) for r in D.doc_rows(f).collect()} == {1: ("entry", ["boot"]), 2: ("hub", list("abcdef")), 3: ("module", []), 4: ("module", []), 5: ("module", ["x"]), 6: ("module", [])}
    assert {r.node: r.line for r in D.facts_line(f, f.where("node in (2, 5)")).collect()}[2] == "hub · in a cycle · 6 in, 1 out · 6 functions"
    edges = spark.createDataFrame([(9, 2), (8, 2), (7, 2)], "src long, dst long")
    assert {r.node: r.text for r in D.file_doc(f, edges).collect()} == {
        1: "main.js is an entry point with 3 imports. Functions: boot.", 2: "hub.js carries 6 importers, such as 7, 8. Functions: a, b, c, d and 2 more.", 3: "leaf.js is a leaf with 1 importer.",
        4: "lone.js has no links.", 5: "mid.js has 2 imports and 2 importers. Functions: x.", 6: "top.js has 1 import and no importer.",
    }
    assert {r.folder: r.text for r in D.folder_doc(f).collect()} == {"src": "2 files. Most imported: hub.js (6). Entries: main.js.", "lib": "4 files."}


def test_documentation_round_trip(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    pairs = [("a.js", "reads: all, of it"), ("b c.py", "writes\n  two lines"), ("a.js", "again"), ("empty", "  ")]
    files = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in pairs))
    text = one(D.write_doc(F.lit(" About\nthis folder "), files))
    assert text == "FOLDER: About this folder\nFILE: a.js: reads: all, of it\nFILE: b c.py: writes two lines\nFILE: a.js: again"
    read = one(D.parse_doc(F.lit("Here you are:\n\n" + text.replace("FOLDER", "folder") + "\nfolder: and more\nbye")))
    assert read.brief == "About this folder and more" and [tuple(f) for f in read.files] == [("a.js", "again"), ("b c.py", "writes two lines")]
    assert one(D.parse_doc(F.lit("one\n\n two \nthree\nFILE: nothing"))).brief == "one two" and one(D.parse_doc(F.lit(None).cast("string"))).brief == ""


def test_payloads_fit(spark):
    parts = spark.createDataFrame([(k, r, "x" * (10 * r)) for k in (1, 2) for r in range(1, 8 if k == 1 else 3)], "key int, rank int, item string")
    got = {r.key: r for r in A.packed(parts, 100).collect()}
    assert (len(got[1]["items"]), got[1].left_out, got[1].size) == (3, 4, 60) and (len(got[2]["items"]), got[2].left_out) == (2, 0)
    f = facts(spark).withColumn("is_test", F.lit(False))
    edges = spark.createDataFrame([(1, 2), (5, 2), (2, 3)], "src long, dst long")
    made = json.loads(A.overview(f, edges, 120).first().json)
    assert made["stats"] == {"files": 6, "connections": 3, "orphans": 2} and [p["kind"] for p in made["parts"]] == ["entry", "hub"] and made["leftOut"] == 1
    files = {r.payload: json.loads(r.json) for r in A.explain_file(f, edges, 50).collect()}
    assert files["file/2"]["near"] == [{"side": "importer", "other": 1}] and files["file/2"]["leftOut"] == 2 and files["file/4"] == {"file": {"node": 4, "name": "lone.js", "role": "module", "fan_in": 0, "fan_out": 0}, "near": [], "leftOut": 0}
    empty = A.overview(f.limit(0), edges.limit(0)).first().json
    assert json.loads(empty) == {"stats": {"files": 0, "connections": 0, "orphans": 0}, "parts": [], "leftOut": 0}


def log(*commits):
    return "".join(f"\x1e{h}\x1f{a}\x1f{a}@x\x1f{d}\n" + "\n".join(files) + "\n\n" for h, a, d, files in commits)


def test_logs_of_a_folder(spark, tmp_path):
    (tmp_path / "one.log").write_text(log(("a1", "Ann", "2024-01-02", ["x.js", "y z.js"]), ("b2", "Bob", "2024-01-03", [])))
    (tmp_path / "two.log").write_text(log(*((f"c{k}", "Cy", f"2024-02-{k:02d}", ["f"]) for k in range(1, 20))))
    (tmp_path / "empty.log").write_text("fatal: your current branch 'main' does not have any commits yet\n")
    (tmp_path / "none.log").write_text("fatal: not a git repository (or any of the parent directories): .git\n")
    batch = git.read_log(spark, str(tmp_path))
    rows = sorted(map(tuple, batch.collect()))
    assert rows[:2] == [("one", "a1", "Ann", "Ann@x", "2024-01-02", ["x.js", "y z.js"]), ("one", "b2", "Bob", "Bob@x", "2024-01-03", [])] and len(rows) == 21
    streamed = activity.finish(git.read_log(spark, str(tmp_path), stream=True), "log")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    states = {r.repo: (r.commits, r.reason) for r in git.log_states(spark, str(tmp_path)).collect()}
    assert states["one"] == (2, None) and states["two"] == (19, None) and states["empty"] == (0, "no commits")
    assert sorted(r["hash"] for r in git.newest(batch, 3).where("repo = 'two'").collect()) == ["c17", "c18", "c19"]


def test_equal_texts_do_not_mix(spark):
    text = "diff --git a/f b/f\n@@ -1 +1 @@\n-x\n+y\n"
    rows = git.diff_files(spark.createDataFrame([("r", text), ("r", text)], "repo string, text string")).collect()
    assert [(r.additions, r.deletions, r.hunks) for r in rows] == [(1, 1, 1)] * 2


def test_binary_files_and_truncation(spark, tmp_path):
    for name, data in {"a.js": b"a \nb 0\nP\n", "b.js": b"a \nb\0\0c", "c.js": b"ab\0c", "d.js": b"\x10\x01 ok", "x/e.js": b"e", "x/y/f.js": b"f"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = repository.read(spark, str(tmp_path))
    assert {r.path for r in files.where("reason = 'binary'").collect()} == {"b.js", "c.js"}
    assert [tuple(r) for r in repository.truncation(files, 4).collect()] == [(4, 2, 2)] and repository.truncation(files, 6).count() == 0


def test_packages_and_reports(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x
    package = lambda f: lambda t: f(manifests.package_json(t))
    assert one('{"main": "./a.js", "bin": {"x": "./b.js", "y": "c.js"}}', package(manifests.entry_points)) == ["a.js", "b.js", "c.js"] and one('{"bin": "./b.js"}', package(manifests.entry_points)) == ["b.js"] and one("{}", package(manifests.entry_points)) == []
    assert one('{"workspaces": ["a/", "b/*"]}', package(manifests.workspaces)) == ["a", "b/*"] == one('{"workspaces": {"packages": ["a", "b/*/"]}}', package(manifests.workspaces)) and one("{}", package(manifests.workspaces)) == []
    assert one('{"scripts": {"predev": "x"}}', package(manifests.has_server)) and not one('{"scripts": {"test": "start"}}', package(manifests.has_server)) and not one("{}", package(manifests.has_server))
    found = one('{"files": ["a.js"], "dependencies": ["left"], "unused": [{"name": "f", "file": "b.js", "line": 4}], "unresolved": [{"name": "./x", "file": "c.js"}]}', manifests.knip)
    assert [(r.rule, r.path, r.line, r.severity, r.what) for r in found] == [("knip:unused-file", "a.js", 1, "medium", "a.js"), ("knip:unused-dependency", "left", 1, "low", "left"), ("knip:unused-export", "b.js", 4, "low", "f"), ("knip:unresolved", "c.js", 1, "medium", "./x")]
    assert one("{}", manifests.knip) == [] and [(r.what, r.dev, r.path) for r in one('{"dependencies": ["a"], "devDependencies": ["b"]}', manifests.depcheck)] == [("a", False, "package.json"), ("b", True, "package.json")]


def test_engines(spark):
    status = spark.createDataFrame([("semgrep", "Semgrep", None, True), ("knip", None, "dead", True), ("vulture", "Vulture", "dead", False)], "id string, label string, kind string, available boolean")
    passes = "id string, ok boolean, available boolean, findings long, ms long, reason string"
    rows = manifests.engine_rows(status, spark.createDataFrame([("semgrep", True, True, 3, 40, None), ("knip", False, True, 0, 5, "broke"), ("vulture", False, False, 0, 0, "absent")], passes))
    assert {r.id: tuple(r)[1:] for r in rows.collect()} == {"semgrep": ("Semgrep", "security", True, True, False, 3, 40, None), "knip": ("knip", "dead", True, False, True, 0, None, "broke"), "vulture": ("Vulture", "dead", False, False, False, 0, None, None)}
    summary = lambda r, once=True: tuple(manifests.engine_summary(r, once).first())
    assert summary(rows) == ("found", "1 of 3 ran, 3 findings, 1 failed, 1 not installed") and summary(rows, False)[0] == "idle" and summary(rows.withColumn("findings", F.lit(0)))[0] == "clean"
    none = manifests.engine_rows(status, spark.createDataFrame([], passes))
    assert summary(none) == ("none", "No engine could run.") and summary(none.withColumn("available", F.lit(False))) == ("none", "No engine is installed.")
