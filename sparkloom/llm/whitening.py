"""Whitening of embeddings by their leading principal components (operator 13).

An entry ``c`` becomes the whole number ``x = floor(256 * c)``, so counts, sums and
deviations are exact.  The fit list holds every different vector once; it is written
to the shared folder.  Every task adds up the products of its own centred rows, Spark
adds these up by matrix entry, and only the finished covariance, as large as the
vectors are wide, reaches the driver: never rows.  ``eigen.leading`` finds its leading
eigenvectors; mean and projection are broadcast and applied to all rows where they lie.

Copies don't weigh more: they meet in one group of the fit list, with partial groups
in every task, so a vector that holds a third of all rows moves a few rows a task.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are
left out; vectors of other lengths than the most frequent one of the fit list (of
equally frequent ones the longest) belong to another space and are left out as well;
null and repeated ids are kept, each row by itself; components of no variance (less
than ``LEAST`` of the trace) can't be scaled to one and are left out, so a single
vector or equal ones give no rows, as an empty table does; sums or deviations beyond
64 bits raise an error; vectors wider than ``MAX_WIDTH`` are refused; extra columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import eigen
from sparkloom.llm.shared import stage

SCALE = 256
COMPONENTS = 4
#: Components below this part of the trace count as none.
LEAST = 1e-12
#: Bound of the covariance on the driver: 4096 * 4096 doubles are 128 MB.
MAX_WIDTH = 4096
_SAFE = 2**62


@dataclass(frozen=True)
class Whitening:
    """A fitted projection: n vectors with these sums, and eigenvalues and vectors of their covariance."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S)^2 of every row, exact."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * max(x.shape[1], 1) < _SAFE else object
        d = x.astype(kind) * self.n - np.array(self.sums, kind)
        return list(map(int, (d * d).sum(axis=1)))


def entries(vector: Column) -> Column:
    """Whole numbers of a vector; null where it has none."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            x = x if int(np.abs(x).max()) * len(x) < _SAFE else x.astype(object)
            found = list(map(int, x.sum(axis=0)))
            total = [a + b for a, b in zip(total, found)] if total else found
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["s"])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a list of vectors (one column ``x``, all of one length); null without variance.

    The list is read twice: for its sums, and for products of its centred rows.
    """
    n = vectors.count()
    if not n:
        return None
    parts = vectors.mapInArrow(_sums, "s array<long>").select(F.posexplode("s").alias("i", "s"))
    sums = tuple(r.s for r in parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect())
    width = len(sums)
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of {width} entries: a covariance of more than {MAX_WIDTH} rows is refused")
    mean = np.array([s / n for s in sums])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            centred = _matrix(batch.column(0)) - mean
            total += centred.T @ centred
        if total.any():
            for i in range(width):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i, i:]], pa.list_(pa.float64()))], ["i", "row"])

    entry = vectors.mapInArrow(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    covariance = np.zeros((width, width))
    for r in entry.groupBy("i", "j").agg((F.sum("v") / n).alias("v")).toLocalIterator():
        covariance[r.i, r.i + r.j] = covariance[r.i + r.j, r.i] = r.v
    trace = float(np.trace(covariance))
    if trace <= 0:
        return None
    values, basis = eigen.leading(covariance, min(components, width))
    kept = values > LEAST * trace
    return Whitening(n, sums, trace, values[kept], basis[:, kept])


def project(rows: DataFrame, model: Whitening, *keep: str) -> DataFrame:
    """The kept columns, ``deviation`` and ``whitened`` (array of components) of every row with whole numbers ``x``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "deviation", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, len(m.sums)), np.int64)
            z = m.project(x)
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            whitened = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(m.deviation(x), pa.int64()), whitened], names)

    kinds = dict(rows.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keep) + "deviation long, whitened array<double>"
    return rows.select("x", *keep).mapInArrow(run, schema)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry, without sign, of the whitened list's covariance minus the identity."""
    z, k = project(vectors, model), len(model.values)
    found = z.agg(*(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """id, deviation, whitened (array) of every row; the model; the identity error."""
    found = rows.select(entries(F.col(vector_col)).alias("x"), F.col(id_col)).where("x is not null")
    vectors = stage(found.select("x").distinct(), "whitening-fit")
    most = vectors.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    model = error = None
    if most is not None:
        same = F.size("x") == most.width
        found, vectors = found.where(same), vectors.where(same)
        model = fit(vectors, components)
    if model is None:
        kind = dict(rows.select(id_col).dtypes)[id_col]
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {kind}, deviation long, whitened array<double>"), None, None
    error = identity_error(vectors, model)
    return project(found, model, id_col), model, error


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four components of every embedding."""
    rows, model, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    explained = [float(v / model.trace) for v in model.values] if model else []
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else None).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.lit(explained).cast("array<double>"), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
