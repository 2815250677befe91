"""Poisson replication against SQL, its own distribution, and small tables."""

import math
import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same
from pyspark.sql import functions as F

from sparkloom.llm import mixing as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, replica string"


def test_query(spark, sf_dir):
    assert_same(m.op5_mixing(spark, sf_dir), m.OP5_SQL, sf_dir)


def test_poisson_table(spark):
    for rate in (0.01, 1.0, 30.0, 900.0):
        table = spark.range(1).select(m.poisson_table(F.lit(rate)).alias("t")).first().t
        want, log = [], -rate
        for k in range(len(table)):
            log += math.log(rate / k) if k else 0
            want.append(math.exp(log) + (want[-1] if k else 0))
        assert max(abs(a - b) for a, b in zip(table, want)) < 1e-9 and table[-1] > 1 - 1e-9


def test_weights_are_met(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('x', 100) text", "'en' lang", "if(id % 4 = 0, 'a', 'b') source", "100L n_chars", "'old' replica")
    got = Counter(r.source for r in m.replicate(docs, {"a": 3.0, "b": 1.0, "c": 5.0}).select("source").collect())
    assert abs(got["a"] / 3000 - 1) < 0.05 and abs(got["b"] / 1000 - 1) < 0.12
    rates = {r.source: (round(r.weight, 9), round(r.rate, 9)) for r in m.rates(docs, {"a": 3.0, "b": 1.0}).collect()}
    assert rates == {"a": (0.75, 3.0), "b": (0.25, round(1 / 3, 9))}


def test_edges(spark):
    rows = [(1, None, "en", None, 0, "x"), (2, "t" * 50, "en", None, 50, "x"), (2, "t" * 50, "en", None, 50, "x"), (None, "u" * 50, "en", "s", 50, "x"), (3, "", "en", "empty", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = m.replicate(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "replica", "shuffle_key"]
    got = out.collect()
    twos = Counter(r.replica for r in got if r.doc_id == 2)
    assert set(twos.values()) <= {2} and not [r for r in got if r.source == "empty"]
    assert m.replicate(df.limit(0)).count() == 0 and m.replicate(df, {}).count() == 0
    assert m.mix(spark, df.drop("replica"), "").columns == df.columns[:-1]


def test_order_is_shuffled(spark):
    docs = spark.range(500).selectExpr("id doc_id", "'abc' text", "'en' lang", "'a' source", "3L n_chars").coalesce(1)
    order = [r.doc_id for r in m.replicate(docs).collect()]
    assert order != sorted(order)


def test_high_rates_are_drawn_in_parts(spark):
    """Mean and variance of a high rate, by tables that stay short."""
    docs = spark.range(500).selectExpr("id doc_id", "'x' text", "'en' lang", "'rare' source", "1L n_chars").unionByName(
        spark.range(1).selectExpr("-1L doc_id", "repeat('y', 500000) text", "'en' lang", "'rest' source", "500000L n_chars")
    )
    rate = {r.source: r.rate for r in m.rates(docs, {"rare": 3.0, "rest": 7.0}).collect()}["rare"]
    assert 300 < rate < 301
    got = Counter(r.doc_id for r in m.replicate(docs, {"rare": 3.0, "rest": 7.0}).where("source = 'rare'").select("doc_id").collect())
    counts = [got[k] for k in range(500)]
    mean = sum(counts) / 500
    spread = sum((c - mean) ** 2 for c in counts) / 499
    assert abs(mean - rate) < 4 * (rate / 500) ** 0.5 and 0.75 < spread / rate < 1.3


def test_query_in_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(m, "PART_RATE", 0.25)
    assert_same(m.op5_mixing(spark, sf_dir), m.OP5_SQL.replace("rate / 64", "rate / 0.25"), sf_dir)
