"""Licence scans against SQL, and inheritance on a small tree."""

import os
import sys
import textwrap

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same

from sparkloom.llm import licences as m


def test_query(spark, sf_dir):
    assert_same(m.op7_licences(spark, sf_dir), m.OP7_SQL, sf_dir)


def test_tree(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, mit + "\ncode", "a", 0), (2, "code", "a/b", 0), (3, "x\n" + apache + "\ny", "a/b", 0), (4, "code\n" + apache, "a/b/c", 0), (5, None, "a/b/c/d", 0),
        (6, "", "z", 0), (7, "We talk of a licence and other things that nobody grants here at all", "z", 0), (8, mit, "y", 1), (8, mit, "y", 1), (9, "q", "y", None),
    ]
    got = {(r.doc_id, r.licence, r.origin, r.from_dir) for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string, dir string, licence int")).collect()}
    assert got == {
        (1, "MIT", "own", "a"), (2, "MIT", "inherited", "a"), (3, "Apache-2.0", "own", "a/b"), (4, "Apache-2.0", "own", "a/b/c"), (5, "Apache-2.0", "inherited", "a/b/c"),
        (6, None, "none", None), (7, None, "none", None), (8, "MIT", "own", "y"), (9, "MIT", "inherited", "y"),
    }


def wrapped(text, width=70):
    return "\n".join(textwrap.wrap(text, width))


def test_whole_notices_and_files(spark):
    """Notices wrapped over lines, with comment marks, inside a text, and whole licence files."""
    gpl3 = m._GNU_USE.format("GNU General Public License", "3") + "\n\n" + m._GNU_HOPE.format("GNU General Public License")
    agpl, lgpl = (m._GNU_USE.format(f"GNU {x} General Public License", v) for x, v in (("Affero", "3"), ("Lesser", "2.1")))
    bsd3 = "\n\n".join(["Copyright (c) 2020, Ann", m._REDISTRIBUTION, m._NO_NAMES, m._WARRANTY])
    texts = {
        "GPL-3.0": "\n".join("# " + x for x in wrapped(gpl3.split("\n\n")[0]).split("\n")) + "\n\nimport os\n",
        "AGPL-3.0": "A story first.\n\n" + wrapped(agpl) + "\n\nand a story after.\n",
        "LGPL-2.1": wrapped(lgpl, 50) + "\nint main() {}\n",
        "BSD-3-Clause": wrapped(bsd3.replace("\n\n", "@@"), 60).replace("@@", "\n\n"),
        "BSD-2-Clause": wrapped(m._REDISTRIBUTION) + "\n\n" + wrapped(m._WARRANTY),
        "MIT": "MIT License\n\nCopyright (c) 2021 Bo\n\n" + wrapped(m._MIT) + "\n\n" + wrapped(m._MIT_REST),
        "Apache-2.0": "/*\n * " + wrapped(m._APACHE, 60).replace("\n", "\n * ") + "\n *\n * " + wrapped(m._APACHE_REST, 60).replace("\n", "\n * ") + "\n */\npackage x;\n",
        "ISC": wrapped(m._ISC),
    }
    rows = [(k, t, f"d{k}") for k, t in enumerate(texts.values())]
    got = {r.doc_id: (r.licence, r.origin) for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string, dir string")).collect()}
    assert got == {k: (name, "own") for k, name in enumerate(texts)}


def test_ids_and_clashing_columns(spark):
    mit = "Released under the MIT License."
    rows = [(None, mit, "en", "s", "x"), (None, "code", "en", "s", "y"), (1, "code", "en", None, "z")]
    got = sorted((str(r.doc_id), r.dir, str(r.licence), r.origin) for r in m.scan(m.bound_paths(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, dir string"))).collect())
    assert got == [("1", "(none)/0", "None", "none"), ("None", "s/none", "MIT", "inherited"), ("None", "s/none", "MIT", "inherited")]


def test_no_rows(spark):
    assert m.scan(spark.createDataFrame([], "doc_id long, text string, dir string")).count() == 0
    assert m.scan(spark.createDataFrame([(1, "x", "d")], "doc_id long, text string, dir string")).first().origin == "none"


def opening(licence):
    """How a licence file begins, laid out as such files are."""
    title, rest = next((t, r) for i, t, r in m._OPENINGS if i == licence)
    head = title.replace(" Version", "\n                       Version", 1).replace(" http", "\n   http")
    return "                    " + head + "\n\n " + wrapped(rest.split(" Preamble ")[0], 66) + ("\n\n                            Preamble\n\n  " + wrapped(rest.split(" Preamble ")[1]) if " Preamble " in rest else "") + "\n"


def test_licence_files_by_their_openings(spark):
    names = [i for i, _, _ in m._OPENINGS]
    files = {f"{k}": (n, opening(n) + "\n  Other clauses follow here, of which nothing is known.\n") for k, n in enumerate(names)}
    rows = [(int(k), t, f"d{k}") for k, (_, t) in files.items()] + [(100 + int(k), "code", f"d{k}/src") for k in files]
    got = {r.doc_id: (r.licence, r.origin) for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string, dir string")).collect()}
    assert got == {int(k): (n, "own") for k, (n, _) in files.items()} | {100 + int(k): (n, "inherited") for k, (n, _) in files.items()}


INSTALLED = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(INSTALLED), reason="no licence texts on this machine")
def test_whole_licence_files(spark):
    """Official texts, whole, at the top of a folder."""
    names = {"GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [(f, n) for f, n in names.items() if os.path.exists(f"{INSTALLED}/{f}")]
    rows = [(k, open(f"{INSTALLED}/{f}").read(), f"d{k}") for k, (f, _) in enumerate(found)] + [(100 + k, None, f"d{k}/a/b") for k in range(len(found))]
    got = {r.doc_id: (r.licence, r.origin) for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string, dir string")).collect()}
    assert got == {k: (n, "own") for k, (_, n) in enumerate(found)} | {100 + k: (n, "inherited") for k, (_, n) in enumerate(found)}
