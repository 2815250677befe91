"""Code analysis: tokens, statements of every language, calls, and imports resolved to files."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.functions import lexing as L
from sparkloom.functions import paths as P
from sparkloom.operators import grammar as G
from sparkloom.operators import resolution as R
from sparkloom.operators import symbols as S
from pyspark.sql import functions as F


def rows(lang, text, path="f", *kinds):
    found = G.statements(path, lang, text)
    return [r for r in found if not kinds or r["kind"] in kinds]


def names(lang, text, kind, path="f"):
    return [r["name"] for r in rows(lang, text, path, kind)]


@settings(max_examples=200, deadline=None)
@given(text=st.lists(st.one_of(st.sampled_from(["'", '"', "`", "/*", "*/", "//", "#", "\n", "{", "}", "(", ")", "\\", "import ", "def f(", "class A ", '"""', "=>"]), st.text(max_size=4))).map("".join))
def test_any_text_is_read(text):
    for lang in G.GRAMMAR:
        family = L.family_of(lang if lang in L.LANGUAGES or "script" in lang else "generic", f"x.{lang[:3]}")
        code = L.read(text, family)
        assert code.places == sorted(code.places) and len(code.words) == len(code.values) == len(code.starts)
        for r in G.statements("a.x", lang, text):
            assert 1 <= r["line"] <= text.count("\n") + 1 and 0 <= r["at"] <= len(text) and (r["until"] is None or r["start"] <= r["until"] <= len(text))


def test_strings_and_comments_hide_code():
    text = "const a = \"import './no.js'\"; /* function no() {} */ const t = `require('./no2')`\nconst u = 'it\\'s // no comment', v = \"/*\"; // class No {}\nimport './yes.js' /* */; const w = require(\"./yes2\")\n"
    for lang in ("javascript", "typescript"):
        assert [(r["name"], r["line"]) for r in rows(lang, text, "f", "import")] == [("./yes.js", 3), ("./yes2", 3)]
        assert names(lang, text, "function") == names(lang, text, "class") == []


def test_script_imports():
    text = """import D, {
  one,
  two as second, // three
  type Four
} from "./lib/x.js";
import * as all from 'all'; import type { T } from './t'
export { five as six } from './y.js'
export * from '../z'
import 'https://host/mod.js'; const k = await import('./lazy.js'), r = require( './r.json' )
import E from './e.js'"""
    got = [(r["name"], r["line"], r["names"]) for r in rows("javascript", text, "f", "import")]
    assert sorted(got) == sorted([
        ("./lib/x.js", 1, ["default", "one", "two", "Four"]), ("all", 6, ["*"]), ("./t", 6, ["T"]), ("./y.js", 7, ["five"]), ("../z", 8, ["*"]),
        ("https://host/mod.js", 9, []), ("./lazy.js", 9, []), ("./r.json", 9, []), ("./e.js", 10, ["default"]),
    ])


def test_script_exports_and_functions():
    text = """export async function load(a = { b: 1 }, c = f()) { return go(a) }
export default class Store extends Base {
  static async open(path, { mode } = {}) { load(path); if (x) { run() } }
  get size() {
    return size(this)
  }
}
export const pick = (x) => load(x), more = 1
const f2 = async function () { for (;;) { while (1) {} } }, f3 = y => { pick(y) }
export { f2, f3 as third }; exports.old = 1; module.exports = f2; export abstract class Kind {}
export let late; function* gen() {} class Plain {}
"""
    made = {(r["name"], r["detail"], r["line"]) for r in rows("javascript", text, "f", "function")}
    assert made == {("load", "function", 1), ("open", "method", 3), ("size", "method", 4), ("pick", "arrow", 8), ("f2", "function", 9), ("gen", "function", 11)}
    assert {(r["name"], r["detail"]) for r in rows("javascript", text, "f", "export")} == {
        ("load", "function"), ("default", "default"), ("pick", "const"), ("f2", "named"), ("third", "named"), ("old", "const"), ("Kind", "class"), ("late", "const"),
    }
    assert names("javascript", text, "class") == ["Store", "Kind", "Plain"]


def test_typescript():
    text = "import { A } from 'a'\n@Module({ a: [1] })\n@Other\nexport class Box<T, U extends Map<K, V>> extends Base<T> {}\nexport interface Data {}\ntype Name<T> = T; enum Color { Red }\nexport abstract class Plain {}\nconst o = { type: 'x' }; if (require.main === module) go()\n"
    assert [(r["name"], r["names"], r["size"], r["line"]) for r in rows("typescript", text, "f", "class")] == [("Box", ["Module", "Other"], 2, 4), ("Plain", [], 0, 7)]
    assert sorted(names("typescript", text, "interface")) == ["Color", "Data", "Name"]
    assert names("typescript", text, "main") == ["main"] == names("typescript", "if (import.meta.main) {}", "main") and names("typescript", "main()", "main") == []


def test_python():
    text = '''"""import no"""
import os, sys as system
from . import util
from .core.run import (go,
    stop as halt)  # import none
async def top(a="def no():"):
    return helper(a)
class Box(Base):
    def put(self): helper()

    def _own(self):
        # not the end

        top()
def helper():
    class Inner: pass
if __name__ == "__main__":
    top()
'''
    assert [(r["name"], r["line"], r["names"]) for r in rows("python", text, "f", "import")] == [(".", 3, ["util"]), (".core.run", 4, ["go", "stop"]), ("os", 2, []), ("sys", 2, [])]
    assert [(r["name"], r["detail"], r["line"]) for r in rows("python", text, "f", "function")] == [("top", "function", 6), ("put", "method", 9), ("_own", "method", 11), ("helper", "function", 15)]
    assert names("python", text, "class") == ["Box", "Inner"] and names("python", text, "main") == ["main"]


def test_go():
    text = 'package main // import "no"\nimport (\n\tf "fmt"\n\t_ "x.org/a/b"\n)\nimport . "os"\ntype T struct{}\nfunc (t *T) Run(a int) error { return nil }\nfunc Map[K any](k K) {}\nfunc main() { s := `\nfunc no() {}` }\n'
    assert [(r["name"], r["line"]) for r in rows("go", text, "f", "import")] == [("os", 6), ("fmt", 2), ("x.org/a/b", 2)]
    assert [(r["name"], r["detail"], r["names"]) for r in rows("go", text, "f", "function")] == [("Run", "method", ["T"]), ("Map", "function", []), ("main", "function", [])]
    assert names("go", text, "package") == ["main"] == names("go", text, "main") and names("go", text.replace("package main", "package other"), "main") == []


def test_rust():
    text = "mod a; pub use crate::b::{C, D}; use std::fmt as f;\npub async unsafe fn run<'a>(x: &'a str) -> char { '\"' }\npub(crate) fn half() {} unsafe fn g() {} // fn no() {}\npub struct App; enum Own {} pub trait T {}\nfn main() {}\n"
    assert names("rust", text, "import") == ["a", "crate::b::", "std::fmt"]
    assert [(r["name"], r["detail"]) for r in rows("rust", text, "f", "function")] == [("run", "pub"), ("half", "function"), ("g", "function"), ("main", "function")]
    assert [(r["name"], r["detail"]) for r in rows("rust", text, "f", "class")] == [("App", "pub"), ("Own", "class"), ("T", "pub")] and names("rust", text, "main") == ["main"]


def test_java_and_csharp():
    text = 'package a.b;\nimport a.c.D; import static a.c.E.max; import a.d.*;\n@Service @Path("/x")\npublic final class App { Class k = App.class; public static void main(String[] a) {} }\n@interface Mark {} record P(int x) {}\n'
    assert [(r["name"], r["detail"]) for r in rows("java", text, "f", "import")] == [("a.c.D", ""), ("a.c.E.max", "static"), ("a.d.", "")]
    assert [(r["name"], r["names"], r["line"]) for r in rows("java", text, "f", "class")] == [("App", ["Service", "Path"], 4), ("Mark", [], 5), ("P", [], 5)]
    assert names("java", text, "package") == ["a.b"] and names("java", text, "main") == ["main"]
    text = 'using System; using static A.B.C; using X = Y.Z;\nnamespace A.D { [Api][Route("x")] public sealed partial class Page { static async Task Main() {} } record struct R; }'
    assert [(r["name"], r["detail"]) for r in rows("csharp", text, "f", "import")] == [("System", ""), ("A.B.C", "static")]
    assert [(r["name"], r["names"]) for r in rows("csharp", text, "f", "class")] == [("Page", ["Api", "Route"]), ("R", [])] and names("csharp", text, "package") == ["A.D"] and names("csharp", text, "main") == ["main"]


def test_c_ruby_php():
    c = '#include "u.h"\n# include <sys/io.h>\nstatic int *add(int a,\n  int b)\n{ return a; }\nint main(void) { if (x) { } }\nint later(int);\n'
    assert [(r["name"], r["detail"]) for r in rows("generic", c, "a.c", "import")] == [("u.h", "local"), ("sys/io.h", "system")]
    assert names("generic", c, "function", "a.c") == ["add", "main"] and names("generic", c, "main", "a.c") == ["main"]
    ruby = "require 'json' # require 'no'\nrequire_relative \"lib/a\"\nmodule A::B\n  class C\n    def self.go?(x) = x\n    def run!\n    end\n  end\nend\n"
    assert [(r["name"], r["detail"]) for r in rows("generic", ruby, "a.rb", "import")] == [("lib/a", "require_relative"), ("json", "require")]
    assert names("generic", ruby, "function", "a.rb") == ["go?", "run!"] and names("generic", ruby, "class", "a.rb") == ["A::B", "C"]
    php = "<?php\nrequire_once 'v/a.php'; include('b.php');\nuse App\\Models\\User;\nclass K { function go($x) {} } # class No\n"
    assert [(r["name"], r["detail"]) for r in rows("generic", php, "a.php", "import")] == [("v/a.php", "require"), ("b.php", "require"), ("App\\Models\\User", "use")]
    assert names("generic", php, "function", "a.php") == ["go"] and names("generic", php, "class", "a.php") == ["K"]


def table(spark, repo):
    return spark.createDataFrame(list(repo.items()), "path string, text string").withColumn("lang", P.language_of(F.col("path")))


def analysed(spark, repo):
    files = table(spark, repo)
    found = S.extract(files.where("lang is not null")).cache()
    return found, R.resolve(found, files).cache(), files


def test_calls(spark):
    repo = {
        "a.js": "export function main() { boot(); helper(); }\nfunction boot() { helper(); boot() }\nfunction helper() {}\nclass W {\n  render() {\n    helper();\n    const inner = () => boot()\n  }\n}\n",
        "b.py": "def a():\n    b()\n    'c()'\n\ndef b(): pass\nclass K:\n    def c(self):\n        a()\n        b()\nb()\n",
        "c.js": "const one = () => two('x()'); const two = (f) => {\n one() }\n// two()\n",
    }
    found, _, _ = analysed(spark, repo)
    got = {(r.path, r.caller, r.callee, r.line) for r in S.calls(found).collect()}
    assert got == {("a.js", "main", "boot", 1), ("a.js", "main", "helper", 1), ("a.js", "boot", "helper", 2), ("a.js", "render", "helper", 6), ("a.js", "render", "boot", 7), ("a.js", "inner", "boot", 7), ("b.py", "a", "b", 2), ("b.py", "c", "a", 8), ("b.py", "c", "b", 9), ("c.js", "one", "two", 1), ("c.js", "two", "one", 2)}
    near = {(r.path, r.caller, r.callee) for r in S.calls(found, innermost=True).collect()}
    assert ("a.js", "render", "boot") not in near and ("a.js", "inner", "boot") in near


def test_exports_by_language(spark):
    repo = {"a.py": "def f(): pass\ndef _g(): pass\nclass K:\n  def m(self): pass\n", "b.go": "package b\nfunc Open() {}\nfunc close() {}\nfunc (t T) Do() {}\n", "c.rs": "pub fn a() {} fn b() {} pub struct C;", "D.java": "class D {} interface E {}", "e.js": "export const x = 1; export { x as y }; export default 3"}
    found, _, _ = analysed(spark, repo)
    assert {(r.path, r.name, r.kind) for r in S.exports(found).collect()} == {
        ("a.py", "f", "function"), ("a.py", "K", "class"), ("b.go", "Open", "function"), ("b.go", "Do", "method"), ("c.rs", "a", "function"), ("c.rs", "C", "class"), ("D.java", "D", "class"), ("D.java", "E", "class"),
        ("e.js", "x", "const"), ("e.js", "y", "named"), ("e.js", "default", "default"),
    }


def resolved(spark, repo):
    _, done, files = analysed(spark, repo)
    return {(r.path, r.name): r.target or (r.package and r.package + "/") or r.outside or r.state for r in done.collect()}, done, files


def test_scripts_resolve(spark):
    repo = {
        "src/index.js": "import './util'; import './things'; import 'react'; import '@scope/pkg/deep'; import 'node:fs'; import './missing'; import '../src/ui/Button.js'; import '/js/u.js'",
        "src/util.js": "", "src/things/index.ts": "", "src/ui/Button.tsx": "", "public/js/u.js": "", "js/u.js": "", "public/app.js": "import '/js/u.js'", "src/x.js": "import './y'", "src/y.mjs": "", "src/y.ts": "", "src/y/index.js": "",
    }
    got, _, _ = resolved(spark, repo)
    assert got == {
        ("src/index.js", "./util"): "src/util.js", ("src/index.js", "./things"): "src/things/index.ts", ("src/index.js", "react"): "react", ("src/index.js", "@scope/pkg/deep"): "@scope/pkg", ("src/index.js", "node:fs"): "fs",
        ("src/index.js", "./missing"): "unresolved", ("src/index.js", "../src/ui/Button.js"): "src/ui/Button.tsx", ("src/index.js", "/js/u.js"): "js/u.js", ("public/app.js", "/js/u.js"): "public/js/u.js", ("src/x.js", "./y"): "src/y.mjs",
    }


def test_aliases(spark):
    config = '{ // aliases\n"compilerOptions": { "baseUrl": "./app/", "paths": { "@/*": ["none/*", "src/*"], "@/special": ["src/s.js"], "@/deep/*": ["gone/*"], "~*.css": ["styles/*"], "odd": [] } /* "x" */ }, "include": ["**/*"] }'
    repo = {
        "tsconfig.json": config, "jsconfig.json": "{}", "app/src/s.js": "", "app/src/g$1.js": "", "app/lib/base.ts": "", "app/styles/a.js": "",
        "m.ts": "import '@/special'; import '@/g$1'; import '@/lost'; import '@/deep/s'; import 'lib/base'; import 'react'; import '~a.css'; import 'odd'; import '@/'",
    }
    got, done, _ = resolved(spark, repo)
    assert {k[1]: v for k, v in got.items()} == {"@/special": "app/src/s.js", "@/g$1": "app/src/g$1.js", "@/lost": "unresolved", "@/deep/s": "unresolved", "lib/base": "app/lib/base.ts", "react": "react", "~a.css": "app/styles/a.js", "odd": "unresolved", "@/": "unresolved"}
    assert tuple(R.tally(done).first()) == (9, 4, 1, 4, 56)
    assert [tuple(r) for r in R.worst(done, 2).collect()] == [("@/", 1, "m.ts"), ("@/deep/s", 1, "m.ts")]
    # of two configurations the first that says anything; broken ones say nothing
    rows_of = lambda repo: [tuple(r) for r in R.tsconfig(table(spark, repo)).collect()]
    assert rows_of({"tsconfig.json": "{ broken", "jsconfig.json": '{"compilerOptions": {"baseUrl": "src"}}', "a/tsconfig.json": '{"compilerOptions": {"baseUrl": "no"}}'}) == [("src", None, None)]
    assert rows_of({"tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"a//b": ["x//y"]}}}'}) == [(".", "a//b", ["x//y"])] and rows_of({"a.js": ""}) == []
    root, _, _ = resolved(spark, {"tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"]}}}', "src/a.ts": "", "lib/b.js": "", "m.ts": "import '@/a'; import 'lib/b'; import 'src/a'; import 'vue'"})
    assert {k[1]: v for k, v in root.items()} == {"@/a": "src/a.ts", "lib/b": "lib/b.js", "src/a": "src/a.ts", "vue": "vue"}


def test_other_languages_resolve(spark):
    repo = {
        "pkg/__init__.py": "", "pkg/sib.py": "", "other/__init__.py": "", "pkg/sub/deep.py": "from .. import sib\nfrom ..sib import x\nimport other\nimport near\nfrom django.conf import y\nfrom ...gone import z", "pkg/sub/near.py": "",
        "go.mod": "module ex.com/p\n\ngo 1.2\n", "cmd/main.go": 'package main\nimport "ex.com/p/in/store"\nimport "fmt"\nimport "github.com/a/b/c"\nimport "ex.com/p/none"\n', "in/store/a.go": "package store", "in/store/b.go": "package store",
        "src/main.rs": "mod model; use crate::model::User; use std::io; use ::x::Y;", "src/model.rs": "use super::util::h; use self::part::P; use crate::net;", "src/util.rs": "", "src/model/part/mod.rs": "", "src/net/mod.rs": "",
        "j/src/a/app/App.java": "package a.app; import a.model.User; import a.model.Out.In; import static a.cfg.C.MAX; import java.util.List;", "j/src/a/model/User.java": "package a.model;", "j/src/a/model/Out.java": "package a.model;", "j/src/a/cfg/C.java": "package a.cfg;",
        "cs/Program.cs": "using System; using Acme.Models; using Acme.Models.User; using static Acme.Models.Gone;", "cs/Models/User.cs": "namespace Acme.Models;", "cs/Models/Order.cs": "namespace Acme.Models;",
        "c/main.c": '#include "u.h"\n#include <stdio.h>\n#include "far.h"\n#include "lost.h"', "c/u.h": "", "inc/far.h": "", "r/app.rb": "require_relative 'lib/h'\nrequire 'json'\n", "r/lib/h.rb": "", "p/a.php": "<?php\nuse App\\M\\U;\nrequire 'x/y.php';", "p/x/y.php": "", "p/z/U.php": "",
    }
    got, done, files = resolved(spark, repo)
    by = {}
    for (path, name), to in got.items():
        by.setdefault(path, {})[name] = to
    assert by["pkg/sub/deep.py"] == {"..": "pkg/__init__.py", "..sib": "pkg/sib.py", "other": "other/__init__.py", "near": "pkg/sub/near.py", "django.conf": "django", "...gone": "unresolved"}
    assert by["cmd/main.go"] == {"ex.com/p/in/store": "in/store/", "fmt": "fmt", "github.com/a/b/c": "github.com/a/b", "ex.com/p/none": "unresolved"}
    assert by["src/main.rs"] == {"model": "src/model.rs", "crate::model::User": "src/model.rs", "std::io": "unresolved", "::x::Y": "unresolved"}
    assert by["src/model.rs"] == {"super::util::h": "src/util.rs", "self::part::P": "src/model/part/mod.rs", "crate::net": "src/net/mod.rs"}
    assert by["j/src/a/app/App.java"] == {"a.model.User": "j/src/a/model/User.java", "a.model.Out.In": "j/src/a/model/Out.java", "a.cfg.C.MAX": "j/src/a/cfg/C.java", "java.util.List": "unresolved"}
    assert by["cs/Program.cs"] == {"System": "unresolved", "Acme.Models": "cs/Models/", "Acme.Models.User": "cs/Models/User.cs", "Acme.Models.Gone": "unresolved"}
    assert by["c/main.c"] == {"u.h": "c/u.h", "stdio.h": "stdio.h", "far.h": "inc/far.h", "lost.h": "unresolved"}
    assert by["r/app.rb"] == {"lib/h": "r/lib/h.rb", "json": "json"} and by["p/a.php"] == {"App\\M\\U": "p/z/U.php", "x/y.php": "p/x/y.php"}
    links = {(r.src, r.dst) for r in R.edges(done, files).collect()}
    assert {d for s, d in links if s == "cmd/main.go"} == {"in/store/a.go", "in/store/b.go"} and {d for s, d in links if s == "cs/Program.cs"} == {"cs/Models/User.cs", "cs/Models/Order.cs"}


def test_java_roots(spark):
    for source, model in (("src/main/java/com/acme/svc/O.java", "src/main/java/com/acme/model/M.java"), ("com/acme/svc/O.java", "com/acme/model/M.java"), ("x/com/acme/svc/y/com/acme/svc/O.java", "x/com/acme/svc/y/com/acme/model/M.java")):
        got, _, _ = resolved(spark, {source: "package com.acme.svc; import com.acme.model.M;", model: "package com.acme.model;"})
        assert got == {(source, "com.acme.model.M"): model}
    assert set(resolved(spark, {"other/O.java": "package com.acme; import com.acme.M;", "com/acme/M.java": "", "N.java": "import com.acme.M;"})[0].values()) == {"unresolved"}


def test_unused_exports_of_a_repository(spark):
    repo = {"a.js": "import { used } from './b.js'; import * as all from './c.js'", "b.js": "export const used = 1; export const unused = 2", "c.js": "export const any = 1", "d.js": "export const entry = 1"}
    found, done, _ = analysed(spark, repo)
    dead = S.dead_exports(S.exports(found).select("path", "name"), S.used_names(done), spark.createDataFrame([("d.js",)], "path string"))
    assert [tuple(r) for r in dead.collect()] == [("b.js", "unused")]


def test_empty_tables(spark):
    files = table(spark, {"a.js": ""})
    found = S.extract(files.limit(0))
    done = R.resolve(found, files.limit(0))
    assert found.count() == done.count() == R.edges(done).count() == S.calls(found).count() == S.exports(found).count() == 0
    assert tuple(R.tally(done).first()) == (0, 0, 0, 0, 100)


@pytest.mark.parametrize("lang", sorted(G.GRAMMAR))
def test_long_files(lang):
    text = "x = f(a, [b, {c: 'd'}]);\n" * 20_000
    assert G.statements("a.rb" if lang == "ruby" else "a.php" if lang == "php" else "a.c", lang if lang not in ("c", "ruby", "php") else "generic", text) == []
