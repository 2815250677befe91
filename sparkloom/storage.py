"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only in local mode, where all tasks are on this machine, a temporary folder serves where none is named.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.sparkloom.work.dir", None)
    if not named:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.sparkloom.work.dir", named)
    return named.rstrip("/")


#: Folders of staged tables that a ``temporary`` block is to delete, one list a block.
_WRITTEN: list[list[str]] = []


def note(path: str) -> str:
    """Tells the innermost ``temporary`` block of a folder that is about to be written."""
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables staged inside the block when it ends.

    A query's result may still read its staged tables, so write or collect it inside:
    ``with temporary(spark): query(spark, folder).write.parquet(out)``.
    """
    _WRITTEN.append([])
    try:
        yield
    finally:
        conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _WRITTEN.pop():
            path_of(path).getFileSystem(conf).delete(path_of(path), True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = note(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task that ``spread`` aims at.  Fixed value.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by the keys into parts of a bounded size, as many as there are cores at least.

    Small files are read by one task and compressed rows are dealt to few, however much
    work or memory a row takes; a number of parts that is given stays.
    """
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(least, rows // TASK_ROWS + 1), *keys)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
