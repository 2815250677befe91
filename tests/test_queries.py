"""Every query of the library against its SQL."""

import pytest
from oracle import TABLES, assert_same

from sparkloom.queries import ORACLES, QUERIES

#: Each of these takes ten seconds or more on the whole tables, so they run on a small graph here; the driver's own comparison runs them all.
SLOW = {"v_tour", "g_scc", "top_cycles", "g_blast_all", "g_health", "top_risk", "agg_health", "g_closure", "g_betweenness"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    """The smallest tables with the lines of few orders: a graph of some hundred edges."""
    folder = str(tmp_path_factory.mktemp("small"))
    for name in TABLES:
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        table = table.where("l_orderkey < 120") if name == "lineitem" else table
        table.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(SLOW & set(ORACLES)))
def test_slow_query(spark, small_dir, name):
    assert_same(QUERIES[name](spark, small_dir), ORACLES[name], small_dir)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
