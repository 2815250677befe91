"""Licence scans by sparse TF-IDF cosine, with inheritance along directories (operator 7).

* **Units.** A document's licence statements are those of its lines, of its blocks
  (lines up to a blank one, read as one: headers, notices) and of itself as a whole
  (licence files) that have one of ``MARKERS``, the words that make a statement one
  about rights.  A document that frames itself with a statement, as first or last
  line or (of several) block or as a whole of several blocks, is a licence file of its
  folder.  Whole texts are searched, at any position.
* **Cosine.** Statements of equal terms are compared once, with templates from a
  sentence to a whole text.  Terms are lower-case runs of
  letters and digits; their document frequencies are counted over all statements
  of the corpus and the templates; each statement takes the template of the
  highest cosine of at least ``THRESHOLD`` (ties: the smaller licence id).
* **Inheritance.** A document with a statement of its own has the one with most
  evidence (cosine times the statement's length, so a whole text goes before parts); any
  other takes the licence of the nearest directory upwards that has a licence
  file (in a directory: the file with most evidence, then the smaller licence id),
  found by joining every directory's ancestors with the licence files' paths.

Everything is DataFrame functions.  Texts are never shuffled; statements are
grouped with partial counts, so a line shared by a third of all documents is one
row a task; documents meet their directory's licence in a join whose hot side
Spark can split.

Edge cases: null and empty texts have no statements; a null source is the
directory ``(none)``; rows with one doc_id are scanned one by one and share the
best statement of that id; statements of rows without an id count for their folder only; extra columns are left out; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.shared import stage

MARKERS = ("licen", "creative commons", "copyright", "rights reserved", "public domain", "spdx-", "hereby granted", "redistribution and use")
THRESHOLD = 0.6
_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_NO_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU_USE = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see https://www.gnu.org/licenses/."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_REST = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."


def _parts(title: str, rest: str) -> list[str]:
    """A beginning with its first block, its preamble alone, and all of it."""
    head, _, preamble = rest.partition(" Preamble ")
    return [f"{title} {head}", *([preamble, f"{title} {rest}"] if preamble else [])]


def _gnu(licence: str, name: str, version: str) -> tuple[tuple[str, str], ...]:
    """The notice's first sentence, and the whole notice."""
    return (licence, _GNU_USE.format(name, version)), (licence, f"{_GNU_USE.format(name, version)} {_GNU_HOPE.format(name)}")


_FSF = "Copyright (C) {} Free Software Foundation, Inc. {} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_FSF_OLD, _FSF_NEW = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "https://fsf.org/"
_FREEDOM = "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License{0} intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."
#: How licence files begin: (id, title, what follows).  Fixed values.
_OPENINGS = (
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _FSF.format("2007", _FSF_NEW) + " Preamble The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _FSF.format("1989, 1991", _FSF_OLD) + " Preamble " + _FREEDOM.format(" is")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _FSF.format("2007", _FSF_NEW) + " Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _FSF.format("2007", _FSF_NEW) + " This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _FSF.format("1991, 1999", _FSF_OLD) + " This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1. Preamble " + _FREEDOM.format("s are")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
    ("EPL-2.0", "Eclipse Public License - v 2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT. 1. DEFINITIONS"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\")."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\")."),
)
#: Notices, openings and texts of common licences: (id, text).  Fixed values.
TEMPLATES = (
    *_gnu("AGPL-3.0", "GNU Affero General Public License", "3"),
    *_gnu("GPL-3.0", "GNU General Public License", "3"),
    *_gnu("GPL-2.0", "GNU General Public License", "2"),
    *_gnu("LGPL-3.0", "GNU Lesser General Public License", "3"),
    *_gnu("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    *((licence, title) for licence, title, _ in _OPENINGS), *((licence, part) for licence, title, rest in _OPENINGS for part in _parts(title, rest)),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    ("BSD-2-Clause", _REDISTRIBUTION), ("BSD-2-Clause", f"{_REDISTRIBUTION} {_WARRANTY}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTION} {_NO_NAMES}"), ("BSD-3-Clause", f"{_REDISTRIBUTION} {_NO_NAMES} {_WARRANTY}"),
    ("MIT", _MIT), ("MIT", f"MIT License Copyright (c) {_MIT} {_MIT_REST}"),
    ("ISC", _ISC),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, which is in the public domain (CC0)."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: doc_ids of one folder: the table documents has no paths of its own.
FOLDER = 400


def has_marker(text: Column) -> Column:
    low = F.lower(text)
    out = F.contains(low, F.lit(MARKERS[0]))
    for m in MARKERS[1:]:
        out = out | F.contains(low, F.lit(m))
    return out


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bound_paths(docs: DataFrame) -> DataFrame:
    """doc_id, text and dir: ``source/group`` by the id, with a folder below for every language but English."""
    group = F.coalesce(F.floor(F.col("doc_id") / FOLDER).cast("string"), F.lit("none"))
    below = F.when(F.col("lang") != "en", F.col("lang"))
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("(none)")), group, below).alias("dir"))


def statements(files: DataFrame) -> DataFrame:
    """doc_id, dir, line (its terms), key (its digest) and frames of every licence statement: lines, blocks of several lines, whole texts of several blocks."""
    trim = lambda x: F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    some = lambda parts: F.filter(F.transform(parts, trim), lambda x: x != "")
    found = files.where(has_marker(F.col("text"))).select("doc_id", "dir", "text", some(F.split("text", "\n")).alias("lines"), some(F.split("text", r"\n[ \t\r]*\n")).alias("blocks"))

    def units(parts: Column, least: int, keep: Callable[[Column], Column]) -> Column:
        every = F.transform(parts, lambda x, i: F.struct(x.alias("unit"), ((F.size(parts) >= least) & ((i == 0) | (i == F.size(parts) - 1))).alias("frames")))
        return F.filter(every, lambda u: keep(u["unit"]) & has_marker(u["unit"]))

    whole = F.when(F.size("blocks") > 1, F.array(F.struct(F.col("text").alias("unit"), F.lit(True).alias("frames")))).otherwise(F.array().cast("array<struct<unit:string,frames:boolean>>"))
    each = F.concat(units(F.col("lines"), 1, lambda x: F.lit(True)), units(F.col("blocks"), 2, lambda x: F.contains(x, F.lit("\n"))), whole)
    found = found.select("doc_id", "dir", F.explode(each).alias("u"))
    found = found.select("doc_id", "dir", F.array_join(terms(F.col("u.unit")), " ").alias("line"), "u.frames")
    return found.withColumn("key", F.unhex(F.sha2("line", 256)))


def classify(lines: DataFrame) -> DataFrame:
    """key, licence, cosine and evidence (the length of the line along the template) of every distinct line close to a template.

    lines: key, line.  Terms carry the key, not the text, which may be long.
    """
    spark = lines.sparkSession
    templates = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(TEMPLATES)], "template int, licence string, body string")
    corpus = stage(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")), "licence-lines")
    t_terms = templates.select("template", "licence", F.explode(terms(F.col("body"))).alias("term")).groupBy("template", "licence", "term").count()
    l_terms = stage(corpus.select("key", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("key", "n", "term").count(), "licence-terms")
    # document frequencies over all statements, repeats included, and the templates
    df = l_terms.select("term", "n").unionByName(t_terms.select("term", F.lit(1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    size = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select((F.col("n") + len(TEMPLATES)).alias("size"))
    idf = stage(df.join(F.broadcast(size)).select("term", (F.ln((1 + F.col("size")) / (1 + F.col("df"))) + 1).alias("idf")), "licence-idf")
    weigh = lambda x: x.join(idf, "term").withColumn("w", F.col("count") * F.col("idf"))
    # dealt by key once: norms, products with every template and the best of them stay where a statement's terms lie
    l_w, t_w = weigh(l_terms).repartition(F.col("key")), weigh(t_terms)
    l_norm = l_w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l_norm"))
    t_norm = t_w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    # the templates' terms are a fixed table of a few thousand rows
    sides = F.broadcast(t_w.join(t_norm, "template").select("term", "template", "licence", (F.col("w") / F.col("t_norm")).alias("t_part")))
    dots = l_w.select("key", "term", "w").join(sides, "term").groupBy("key", "template", "licence").agg(F.sum(F.col("w") * F.col("t_part")).alias("dot"))
    close = dots.join(l_norm, "key").withColumn("cosine", F.round(F.col("dot") / F.col("l_norm"), 6)).where(F.col("cosine") >= THRESHOLD)
    best = close.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("loss"), "licence", F.round("dot", 6).alias("evidence"))).alias("b"))
    return best.select("key", "b.licence", (-F.col("b.loss")).alias("cosine"), "b.evidence")


def strongest() -> Column:
    """Of several statements the one with most evidence, so a whole text goes before its parts; then the smaller licence id."""
    return F.min(F.struct((-F.col("evidence")).alias("less"), "licence", (-F.col("cosine")).alias("loss")))


def directories(files: DataFrame, declared: DataFrame) -> DataFrame:
    """dir, licence, cosine, from_dir: the nearest licence file at or above every directory."""
    own = declared.where("frames").groupBy("dir").agg(strongest().alias("b"))
    own = own.select(F.col("dir").alias("from_dir"), F.col("b.licence").alias("licence"), (-F.col("b.loss")).alias("cosine"))
    parts = F.split("dir", "/")
    up = files.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("from_dir"))
    near = up.join(own, "from_dir").groupBy("dir").agg(F.max_by(F.struct("licence", "cosine", "from_dir"), F.size(F.split("from_dir", "/"))).alias("b"))
    return near.select("dir", "b.licence", "b.cosine", "b.from_dir")


def scan(files: DataFrame) -> DataFrame:
    """doc_id, dir, licence, origin (own, inherited, none), cosine and from_dir of every file; files: doc_id, text, dir."""
    found = stage(statements(files), "licence-statements")
    declared = stage(found.drop("line").join(classify(found.select("key", "line")), "key").drop("key"), "licence-declared")
    own = declared.groupBy("doc_id").agg(strongest().alias("o"))
    near = directories(files, declared).select("dir", F.struct("licence", "cosine", "from_dir").alias("d"))
    out = files.select("doc_id", "dir").join(own, "doc_id", "left").join(near, "dir", "left")
    has, near_has = F.col("o").isNotNull(), F.col("d").isNotNull()
    return out.select(
        "doc_id", "dir",
        F.when(has, F.col("o.licence")).otherwise(F.col("d.licence")).alias("licence"),
        F.when(has, "own").when(near_has, "inherited").otherwise("none").alias("origin"),
        F.when(has, -F.col("o.loss")).otherwise(F.col("d.cosine")).alias("cosine"),
        F.when(has, F.col("dir")).otherwise(F.col("d.from_dir")).alias("from_dir"),
    )


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited."""
    return scan(bound_paths(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _values() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({k}, {quote(i)}, {quote(t)})" for k, (i, t) in enumerate(TEMPLATES))


_MARKED = " OR ".join(f"contains(lower({{0}}), '{m}')" for m in MARKERS)
OP7_SQL = f"""
WITH files AS (SELECT doc_id, text, concat_ws('/', coalesce(source, '(none)'), coalesce((doc_id // {FOLDER})::VARCHAR, 'none'), CASE WHEN lang <> 'en' THEN lang END) AS dir FROM documents),
cut AS (SELECT doc_id, dir, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda x: x <> '') AS l,
        list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda x: regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda x: x <> '') AS b FROM files WHERE text IS NOT NULL AND ({_MARKED.format("text")})),
every AS (SELECT doc_id, dir, unnest(l) AS unit, unnest(range(len(l))) AS pos_, len(l) AS n FROM cut
  UNION ALL SELECT * FROM (SELECT doc_id, dir, unnest(b) AS unit, unnest([CASE WHEN len(b) > 1 THEN k ELSE -2 END for k in range(len(b))]), len(b) FROM cut) WHERE contains(unit, chr(10))
  UNION ALL SELECT doc_id, dir, text, 0, 1 FROM cut WHERE len(b) > 1),
found AS (SELECT doc_id, dir, array_to_string(list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS line, pos_ = 0 OR pos_ = n - 1 AS frames FROM every WHERE {_MARKED.format("unit")}),
templates(template, licence, body) AS (VALUES {_values()}),
corpus AS (SELECT line, count(*) AS n FROM found GROUP BY 1),
tt AS (SELECT template, licence, term, count(*) AS c FROM (SELECT template, licence, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS term FROM templates) WHERE term <> '' GROUP BY ALL),
lt AS (SELECT line, n, term, count(*) AS c FROM (SELECT line, n, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS term FROM corpus) WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM (SELECT term, n FROM lt UNION ALL SELECT term, 1 FROM tt) GROUP BY 1),
idf AS (SELECT term, ln((1 + (SELECT coalesce(sum(n), 0) + {len(TEMPLATES)} FROM corpus)) / (1 + df)) + 1 AS idf FROM df),
lw AS (SELECT line, term, c * idf AS w FROM lt JOIN idf USING (term)),
tw AS (SELECT template, licence, term, c * idf AS w FROM tt JOIN idf USING (term)),
ln_ AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY 1),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1),
cos_ AS (SELECT line, licence, round(sum(lw.w * tw.w) / any_value(ln_.norm) / any_value(tn.norm), 6) AS cosine, round(sum(lw.w * tw.w) / any_value(tn.norm), 6) AS evidence
        FROM lw JOIN tw USING (term) JOIN ln_ USING (line) JOIN tn USING (template) GROUP BY line, template, licence),
best AS (SELECT line, licence, cosine, evidence FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY cosine DESC, licence, evidence) AS k FROM cos_ WHERE cosine >= {THRESHOLD}) WHERE k = 1),
declared AS (SELECT doc_id, dir, frames, licence, cosine, evidence FROM found JOIN best USING (line)),
own AS (SELECT doc_id, licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY evidence DESC, licence, cosine DESC) AS k FROM declared) WHERE k = 1),
dirs AS (SELECT dir AS from_dir, licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY evidence DESC, licence, cosine DESC) AS k FROM declared WHERE frames) WHERE k = 1),
near AS (SELECT f.doc_id, d.* FROM files f JOIN dirs d ON f.dir = d.from_dir OR starts_with(f.dir, d.from_dir || '/')),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(from_dir) DESC) AS k FROM near) WHERE k = 1)
SELECT f.doc_id, f.dir, coalesce(o.licence, n.licence) AS licence,
       CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN n.doc_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       coalesce(o.cosine, n.cosine) AS cosine, CASE WHEN o.doc_id IS NOT NULL THEN f.dir ELSE n.from_dir END AS from_dir
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN nearest n USING (doc_id)
"""
