"""Exact dedup against plain grouping, also with a digest that clashes."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup as m

SCHEMA = "doc_id long, text string, digest int, id string"
ROWS = [(5, "a b", 1, "x"), (3, "a \t\n b", 2, None), (9, None, 3, "y"), (8, "", 1, "z"), (7, "a b ", 0, None), (4, "ab", 5, "q"),
        (2, "é" * 3000, 1, "k"), (1, "é" * 3000, 1, "k"), (6, "c d", 1, "l"), (6, "c d", 1, "l"), (11, "\x0b\x0c\r x", 0, None), (12, " x", 0, None)]


def expected(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    return sorted((r[0], min(groups[norm(r[1])]), len(groups[norm(r[1])])) for r in rows)


@pytest.mark.parametrize("digest", [m.sha256, lambda t: F.length(t) % 3, lambda t: F.lit(1)])
def test_groups(spark, digest):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in m.exact_dedup(df, digest=digest).collect())
    assert got == expected(ROWS)


def test_normalised(spark):
    out = spark.createDataFrame([(r[1],) for r in ROWS], "t string").select(m.normalised(F.col("t")).alias("n"), "t").collect()
    assert all(r.n == re.sub("[\x20\x09-\x0d]+", " ", r.t or "") for r in out)


def test_filter_misses_no_hit(spark):
    rows = m.keyed(spark.range(2000).selectExpr("id doc_id", "cast(id % 700 as string) text"), m.sha256, "doc_id", "text")
    index = m.compact(m.flush(rows))
    assert m.may_hit(rows, m.hit_filter(index)).count() == 2000
    single = m.keyed(spark.range(5000, 6000).selectExpr("id doc_id", "cast(id as string) text"), m.sha256, "doc_id", "text")
    assert m.may_hit(single, m.hit_filter(index)).count() < 10


def test_indexes_merge(spark):
    rows = lambda a, b: m.keyed(spark.range(a, b).selectExpr("id doc_id", "cast(id % 10 as string) text"), m.sha256, "doc_id", "text")
    both = m.compact(m.compact(m.flush(rows(0, 15))), m.flush(rows(15, 30)))
    assert sorted((r.keep_id, r.members) for r in both.collect()) == [(k, 3) for k in range(10)]


def test_index_in_parts_equals_rebuild(spark):
    parts = [spark.range(a, a + 9).selectExpr("id doc_id", "cast(id * id % 23 as string) text", "id n") for a in range(0, 63, 9)]
    runs = [m.flush(m.keyed(p, m.sha256, "doc_id", "text", "n")) for p in parts]
    index = m.Index()
    for r in runs[:-1]:
        index.add(r)
    assert [len(level) for level in index.levels] == [2, 1]
    before = {bytes(r.digest): tuple(r)[1:] for r in m.compact(*runs[:-1]).collect()}
    asked = {bytes(r.digest) for r in runs[-1].collect()}
    assert {bytes(r.digest): tuple(r)[1:] for r in index.lookup(runs[-1]).collect()} == {d: v for d, v in before.items() if d in asked}
    index.add(runs[-1])
    assert sorted(map(str, index.merged().collect())) == sorted(map(str, m.compact(*runs).collect()))
    assert m.Index().lookup(runs[0]).count() == 0


def test_rows_of_one_id_and_null_ids(spark):
    rows = [(1, "same text", "a"), (5, "same text", "b"), (5, "another text", "c"), (7, "q", "d"), (7, "q", "d"), (None, "q", "e"), (None, "n", "f"), (None, "n", "g"), (9, None, "h"), (9, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(3)
    kept = m.keep_first(spark, df, "")
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(1, "same text"), (5, "another text"), (7, "q"), (None, "n"), (9, "")], key=str)
    assert m.exact_dedup(df).where("kept").count() == 5


def test_no_rows_and_stage(spark, sf_dir):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.exact_dedup(empty).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = m.keep_first(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.keep_id for r in m.op2_exact_dedup(spark, sf_dir).collect()}


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in m.op2_exact_dedup(spark, sf_dir).collect()}
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.values()) == expected([(d.doc_id, d.text) for d in docs])
    for d in docs:
        assert got[d.doc_id].text_sha256 == hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", d.text or "").encode()).hexdigest()
