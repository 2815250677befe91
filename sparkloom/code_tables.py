"""Parts as source files of eight languages: a header and one to four blocks of statements a part.

Texts are built from the rows of ``part``: names and paths carry keys, the number of
blocks is ``1 + p_size % 4``.  ``EXPECTED`` says, statement by statement, what a reader
finds in a block; the SQL of the queries is made of it and never looks at a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom.storage import spread, stage

#: Ending, language, header and block of ``p_partkey % 8``.  {k}: key, {n}: key of the next file of the language, {b}: block, {d}, {e}: folders of k and n.
TEXTS = (
    ("js", "javascript", "// part {k}: import './no.js'", """import {
  load_{n},
  size as size_{b} // import ghost from './ghost.js'
} from '../d{e}/p{n}.js'; const text_{b} = "import './ghost{b}.js'; function ghost() {}";
export function load_{k}_{b}(a, b = {c: 1}) {
  return wrap_{k}_{b}(`function ghost() {}`); /* load_{k}_{b}() */
}
const wrap_{k}_{b} = (x) => load_{k}_{b}(x); export class Store_{b} { }
export { wrap_{k}_{b} as w_{b} };"""),
    ("ts", "typescript", "/* part {k}\n import './no.ts' */", """import type { Row_{n} } from '@/d{e}/p{n}';
@Entity('class Ghost {}')
export class Row_{k}_{b}<A, B extends Map<A, A>> {
}
interface Shape_{b} { type: string } export type Name_{b} = 'x{b}';
function read_{b}() { return "it's // not a comment"; }"""),
    ("py", "python", '"""part {k}\nimport ghost\n"""', """import os.path as path_{b}, sys
from .p{n} import (run_{n}_{b},
    size as size_{b})  # import ghost
class Box_{b}:
    def _open(self):
        return run_{k}_{b}("def ghost():")

    def close_{b}(self):
        pass
def run_{k}_{b}(x): return x"""),
    ("go", "go", "package d{d}\n\n// part {k} import \"ghost\"", """import (
	"fmt"
	next_{b} "gen.org/m/gen/d{e}x{b}"
)
func (s *Box) Open_{b}() error { return nil }
func close_{k}_{b}() string { return `
func Ghost() {}` }"""),
    ("rs", "rust", "// part {k} use ghost;", """use super::p{n}::Row_{b}; mod part_{b};
pub async fn read_{k}_{b}<'a>(x: &'a str) -> char { '"' }
pub(crate) struct Inner_{b} {} pub enum Kind_{b} { A }"""),
    ("java", "java", "package gen.d{d}; // part {k}", """import gen.d{e}.p{n}.Inner_{b};
import static java.util.List{b}.of;
@Service @Path("class Ghost {}")
public final class Page_{k}_{b} { Class<?> c = Page_{k}_{b}.class; }"""),
    ("cs", "csharp", "namespace Acme.d{d}; // part {k}", """using Acme.d{e}.p{n}; using static Acme.d{e}.Gone{b}.Max;
[Api(1)][Route("x")]
public sealed class View_{k}_{b} { string s = @"class Ghost {{b}}"; }"""),
    ("c", "generic", "/* part {k}\n#include \"ghost.h\" */", """#include "p{n}.c"
#include <sys/io{b}.h>
static int *add_{k}_{b}(int a,
  int b)
{ return later("int ghost() {"); }"""),
)
#: kind, detail, name, line in the block (0: of the header's first line), imported names; of each language.
EXPECTED: dict[str, tuple[tuple[str, str, str, int, str], ...]] = {
    "javascript": (
        ("import", "from", "../d{e}/p{n}.js", 1, "load_{n},size"), ("function", "function", "load_{k}_{b}", 5, ""), ("function", "arrow", "wrap_{k}_{b}", 8, ""), ("class", "class", "Store_{b}", 8, ""),
        ("export", "function", "load_{k}_{b}", 5, ""), ("export", "class", "Store_{b}", 8, ""), ("export", "named", "w_{b}", 9, ""),
    ),
    "typescript": (
        ("import", "from", "@/d{e}/p{n}", 1, "Row_{n}"), ("class", "class", "Row_{k}_{b}", 3, "Entity"), ("interface", "interface", "Shape_{b}", 5, ""), ("interface", "interface", "Name_{b}", 5, ""),
        ("function", "function", "read_{b}", 6, ""), ("export", "class", "Row_{k}_{b}", 3, ""), ("export", "type", "Name_{b}", 5, ""),
    ),
    "python": (
        ("import", "import", "os.path", 1, ""), ("import", "import", "sys", 1, ""), ("import", "from", ".p{n}", 2, "run_{n}_{b},size"), ("class", "class", "Box_{b}", 4, ""),
        ("function", "method", "_open", 5, ""), ("function", "method", "close_{b}", 8, ""), ("function", "function", "run_{k}_{b}", 10, ""),
    ),
    "go": (("import", "", "gen.org/m/gen/d{e}x{b}", 1, ""), ("function", "method", "Open_{b}", 5, "Box"), ("function", "function", "close_{k}_{b}", 6, "")),
    "rust": (("import", "", "super::p{n}::Row_{b}", 1, ""), ("import", "", "part_{b}", 1, ""), ("function", "pub", "read_{k}_{b}", 2, ""), ("class", "class", "Inner_{b}", 3, ""), ("class", "pub", "Kind_{b}", 3, "")),
    "java": (("import", "", "gen.d{e}.p{n}.Inner_{b}", 1, ""), ("import", "static", "java.util.List{b}.of", 2, ""), ("class", "class", "Page_{k}_{b}", 4, "Service,Path")),
    "csharp": (("import", "", "Acme.d{e}.p{n}", 1, ""), ("import", "static", "Acme.d{e}.Gone{b}.Max", 1, ""), ("class", "class", "View_{k}_{b}", 3, "Api,Route")),
    "generic": (("import", "system", "sys/io{b}.h", 2, ""), ("function", "function", "add_{k}_{b}", 3, "")),
}
#: The same once a file, at a line of the header or the first block.
ONCE: dict[str, tuple[tuple[str, str, str, int, str], ...]] = {
    "go": (("package", "", "d{d}", 0, ""), ("import", "", "fmt", 1, "")), "java": (("package", "", "gen.d{d}", 0, ""),), "csharp": (("package", "", "Acme.d{d}", 0, ""),), "generic": (("import", "local", "p{n}.c", 1, ""),),
}
CONFIGS = (("tsconfig.json", '{ // aliases\n "compilerOptions": { "paths": { "*": ["lib/*"], "@/*": ["none/*", "gen/*"] } } }'), ("go.mod", "module gen.org/m\n"))
#: Files of a folder: 64 keys, eight of each language.
FOLDER = 64


def _filled(text: str | Column, block: Column | None = None) -> Column:
    k, n = F.col("p_partkey"), F.col("p_partkey") + 8
    out = F.lit(text) if isinstance(text, str) else text
    for mark, value in (("k", k), ("n", n), ("d", F.floor(k / FOLDER)), ("e", F.floor(n / FOLDER)), *([("b", block)] if block is not None else [])):
        out = F.replace(out, F.lit("{" + mark + "}"), value.cast("string"))
    return out


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, lang of a file a part."""
    kinds = F.array(*(F.struct(F.lit(e).alias("ext"), F.lit(g).alias("lang"), F.lit(h).alias("header"), F.lit(b).alias("block")) for e, g, h, b in TEXTS))
    # few bytes a row become a text each: keys are dealt to all cores before, from many files, or filters on paths
    # would be carried to the one task that reads the table
    part = B.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    keys = stage(spread(part, part.count(), "p_partkey"), "source-keys").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    part = keys.select("p_partkey", "p_size", F.get(kinds, (F.col("p_partkey") % 8).cast("int")).alias("t"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda b: _filled(F.col("t.block"), b))
    text = F.concat_ws("\n", _filled(F.col("t.header")), F.array_join(blocks, "\n"))
    return part.select(_filled(F.concat(F.lit("gen/d{d}/p{k}."), F.col("t.ext"))).alias("path"), text.alias("text"), F.col("t.lang").alias("lang"))


def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the two configuration files of the root."""
    return sources(spark, sf_dir).unionByName(spark.createDataFrame([(p, t, None) for p, t in CONFIGS], "path string, text string, lang string"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _filled_sql(text: str) -> str:
    out = _quoted(text)
    for mark, value in (("k", "k"), ("n", "k + 8"), ("d", f"k // {FOLDER}"), ("e", f"(k + 8) // {FOLDER}"), ("b", "b")):
        if "{" + mark + "}" in text:
            out = f"replace({out}, '{{{mark}}}', ({value})::VARCHAR)"
    return out


def statements_sql() -> str:
    """Tables p (k, b, lang, path: a row a block) and found (k, path, lang, kind, detail, name, line, names) of all statements."""
    parts = []
    for i, (ext, lang, header, block) in enumerate(TEXTS):
        above, size = header.count("\n") + 1, block.count("\n") + 1
        for once, rows in ((False, EXPECTED[lang]), (True, ONCE.get(lang, ()))):
            for kind, detail, name, line, names in rows:
                at = "1" if line == 0 else f"{above} + b * {size} + {line}"
                parts.append(f"SELECT k, path, lang, {_quoted(kind)} AS kind, {_quoted(detail)} AS detail, {_filled_sql(name)} AS name, {at} AS line, {_filled_sql(names)} AS names FROM p WHERE lang = {_quoted(lang)}" + (" AND b = 0" if once else ""))
    kinds = ", ".join(f"({i}, {_quoted(e)}, {_quoted(g)})" for i, (e, g, _, _) in enumerate(TEXTS))
    return (
        f"t(i, ext, lang) AS (VALUES {kinds}), p AS (SELECT p_partkey AS k, unnest(range(0, 1 + p_size % 4)) AS b, lang, 'gen/d' || (p_partkey // {FOLDER}) || '/p' || p_partkey || '.' || ext AS path FROM part JOIN t ON i = p_partkey % 8), "
        f"found AS ({' UNION ALL '.join(parts)})"
    )


def sources_sql() -> str:
    """Table sources (path, text, lang): the same texts in SQL."""
    rows = ", ".join(f"({i}, {_quoted(e)}, {_quoted(g)}, {_quoted(h)}, {_quoted(b)})" for i, (e, g, h, b) in enumerate(TEXTS))
    fill = lambda x, marks: x if not marks else f"replace({fill(x, marks[1:])}, '{{{marks[0][0]}}}', ({marks[0][1]})::VARCHAR)"
    marks = [("k", "p_partkey"), ("n", "p_partkey + 8"), ("d", f"p_partkey // {FOLDER}"), ("e", f"(p_partkey + 8) // {FOLDER}")]
    return (
        f"st(i, ext, lang, header, block) AS (VALUES {rows}), sources AS (SELECT 'gen/d' || (p_partkey // {FOLDER}) || '/p' || p_partkey || '.' || ext AS path, lang, "
        f"{fill('header', marks)} || chr(10) || array_to_string([{fill('block', [*marks, ('b', 'b')])} for b in range(0, 1 + p_size % 4)], chr(10)) AS text FROM part JOIN st ON i = p_partkey % 8)"
    )
