"""Staged tables: written to the shared folder, deleted at the end of a block."""

import os

from sparkloom import storage


def staged(spark):
    folder = storage.shared_dir(spark)
    return {x for x in os.listdir(folder) if x.startswith("kept-") or x.startswith("gone-")} if os.path.isdir(folder) else set()


def test_temporary_tables_go(spark):
    before = staged(spark)
    kept = storage.stage(spark.range(3), "kept")
    with storage.temporary(spark):
        first = storage.stage(spark.range(5), "gone")
        with storage.temporary(spark):
            inner = storage.stage(first, "gone")
            assert inner.count() == 5 and len(staged(spark) - before) == 3
        assert first.count() == 5 and len(staged(spark) - before) == 2
    assert kept.count() == 3 and len(staged(spark) - before) == 1


def test_temporary_tables_go_after_errors(spark):
    before = staged(spark)
    try:
        with storage.temporary(spark):
            storage.stage(spark.range(5), "gone")
            raise KeyError("stop")
    except KeyError:
        pass
    assert staged(spark) == before
