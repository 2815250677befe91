"""Toxicity by a character n-gram linear classifier with naive Bayes scaled features (operator 9).

A text's features are the character n-grams (orders ``ORDERS``) of its
lower-cased form with blanks collapsed, hashed to ``2 ** BITS`` slots.  A feature's
value is ``ln(1 + PER * count / length)``, so it tells how often the text uses it.
Each feature is scaled by its naive Bayes log-count ratio between toxic and clean
training texts; a logistic regression over the scaled features gives the score.

* At most ``MAX_TRAINING`` labelled rows are learnt from, one a doc_id, in the order of
  a hash of the doc_id, and no more of them than have ``MAX_VALUES`` values (a text of n
  characters has at most ``3 * n``, and never more than there are slots): the two bounds
  on what is learnt, by rows and by memory.  Every slot is a feature.
* Values of features by label are summed where the training texts lie, then by
  slot, as whole numbers of ``1 / UNITS``: the sums do not depend on their order.
* The regression is fitted in one task over those rows, whose number is bounded; a
  lost executor costs that task.  The driver sees ratios and weights of slots only.
* Scoring is one narrow pass over whole texts with a weight array of fixed size.

Labels are learnt only from rows whose ``crc32(doc_id as text) mod 5`` is not
zero; label, language, source and doc_id are never features.

Edge cases: null and empty texts have no features and score the intercept; with
labels of one kind or none the score is the smoothed share of toxic labels (one third without any); a
null label or null doc_id is not learnt from, a null doc_id is never held out;
repeated labels of one doc_id count once, as toxic if any is; of rows with one
doc_id the smallest text is learnt from; extra columns are left out (and kept by
``drop_toxic``); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.shared import stage

BITS = 18
ORDERS = (3, 4, 5)
#: Most labelled rows that are learnt from.
MAX_TRAINING = 8_000
#: Most values of features of all of them together: eight bytes each in the task that fits.
MAX_VALUES = 128_000_000
#: Uses are counted a so many characters, and values in parts of one.
PER = 1_000
UNITS = 256
#: Values added to every slot, shared by the labels as all values are: a slot never seen has ratio zero.
SMOOTHING = 10.0
#: Strength of the quadratic penalty, steps of the fit and their size.
PENALTY = 1e-3
STEPS = 100
STEP = 0.03
#: Partitions of the (bounded) training rows, and rows of a piece of the fit.
PARTITIONS = 8
PIECE = 200


def units(count: np.ndarray, length: int) -> np.ndarray:
    """Values of n-grams used ``count`` times in a text, in parts of 1 / UNITS."""
    return np.rint(np.log1p(PER * count / max(length, 1)) * UNITS).astype(np.int64)


class Slots:
    """Hashed n-grams of a text; keeps one stamp array between texts."""

    def __init__(self) -> None:
        self.stamp = np.zeros(1 << BITS, np.int32)

    def all(self, text: str | None) -> tuple[np.ndarray, int]:
        """One slot for every use of an n-gram, and the number of characters."""
        chars = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        if len(chars) < 3:
            return np.zeros(0, np.int64), len(chars)
        found = []
        h = chars.astype(np.uint32)
        for n in range(2, ORDERS[-1] + 1):
            if len(chars) < n:
                break
            h = h[:-1] * np.uint32(0x9E3779B1) + chars[n - 1 :]
            if n in ORDERS:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                slot = mixed >> np.uint32(32 - BITS)
                found.append(slot)
        return np.concatenate(found), len(chars)

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct slots and the units of their values."""
        slot, length = self.all(text)
        place = np.arange(len(slot), dtype=np.int32)
        self.stamp[slot] = place
        last = self.stamp[slot]
        first = last == place
        return slot[first], units(np.bincount(last, minlength=len(slot))[first], length)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, label of at most MAX_TRAINING rows that may be learnt from, one a doc_id."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = stage(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING), "toxicity-labels")
    # MAX_TRAINING rows of two numbers: the broadcast has a fixed bound
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = stage(rows.repartition(PARTITIONS), "toxicity-training")
    # sizes of MAX_TRAINING rows at most: one task's running sum, and a broadcast of ids
    cost = F.least(len(ORDERS) * F.length("text").cast("long"), F.lit(1 << BITS))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = rows.select("doc_id", cost.alias("cost")).withColumn("so_far", F.sum("cost").over(order)).where(F.col("so_far") <= MAX_VALUES)
    return rows.join(F.broadcast(fits.select("doc_id")), "doc_id", "left_semi").select("text", "label")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots, sums = Slots(), np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            slot, value = slots.counted(text.as_py())
            sums[label][slot] += value
    seen = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen.astype(np.int32), sums[1][seen], sums[0][seen])], ["slot", "toxic", "clean"])


def log_count_ratios(training: DataFrame) -> DataFrame:
    """slot, ratio of every slot that a training text uses; training: text, label."""
    counts = training.select("text", "label").mapInArrow(_count, "slot int, toxic long, clean long")
    counts = stage(counts.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-counts")
    total = counts.agg((F.sum("toxic") / UNITS).alias("all_toxic"), (F.sum("clean") / UNITS).alias("all_clean"))
    share = F.col("all_toxic") / (F.col("all_toxic") + F.col("all_clean"))
    toxic = (F.col("toxic") / UNITS + SMOOTHING * share) / F.col("all_toxic")
    clean = (F.col("clean") / UNITS + SMOOTHING * (1 - share)) / F.col("all_clean")
    known = (F.col("all_toxic") > 0) & (F.col("all_clean") > 0)
    return counts.join(F.broadcast(total)).select("slot", F.when(known, F.ln(toxic) - F.ln(clean)).otherwise(0.0).alias("ratio"))


class Rows:
    """Training rows of a piece: slots, scaled values, and where each row begins."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ratio: np.ndarray):
        found = [(s, v) if len(s) else (np.zeros(1, np.int64), np.zeros(1, np.int64)) for s, v in found]
        self.size = np.array([len(s) for s, _ in found])
        self.start = np.cumsum(self.size) - self.size
        self.slot = np.concatenate([s for s, _ in found]).astype(np.int32)
        self.scaled = (np.concatenate([v for _, v in found]) / UNITS * ratio[self.slot]).astype(np.float32)
        self.label = np.array(labels, float)

    def errors(self, weights: np.ndarray, bias: float) -> np.ndarray:
        z = np.add.reduceat(weights[self.slot] * self.scaled, self.start) + bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50))) - self.label

    def gradient(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, np.repeat(error, self.size) * self.scaled, minlength=1 << BITS)


def fit(rows: list[Rows], penalty: float | None = None) -> tuple[np.ndarray, float]:
    """Weight of every slot's scaled value, and intercept, by full-batch Adam on the penalised log loss."""
    penalty = PENALTY if penalty is None else penalty
    count = sum(len(r.label) for r in rows)
    share = sum(r.label.sum() for r in rows) / count
    weights, bias = np.zeros(1 << BITS), float(np.log(share / (1 - share)))
    m, v = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for k in range(1, STEPS + 1):
        grad = np.append(penalty * weights, 0.0)
        for r in rows:
            error = r.errors(weights, bias)
            grad[:-1] += r.gradient(error) / count
            grad[-1] += error.sum() / count
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        change = STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        weights, bias = weights - change[:-1], bias - float(change[-1])
    return weights, bias


class Model:
    """Weight of every slot and intercept."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def of(self, slots: Slots, text: str | None) -> float:
        """Log odds of a text."""
        slot, value = slots.counted(text)
        return float(value @ self.weights[slot]) / UNITS + self.bias


def train(docs: DataFrame, labels: DataFrame) -> Model:
    training = training_rows(docs, labels)
    got = training.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if got.toxic in (0, got.n):
        share = (got.toxic + 1) / (got.n + 3)  # below one half without any label: nothing is known, so nothing is toxic
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    rated = log_count_ratios(training).toPandas()  # 2 ** BITS rows at most
    ratio = np.zeros(1 << BITS)
    ratio[rated["slot"].to_numpy(np.int64)] = rated["ratio"].to_numpy(float)
    shared = training.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, rows, scale = Slots(), [], shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, PIECE):
                part = batch.slice(k, PIECE)
                rows.append(Rows([slots.counted(t.as_py()) for t in part.column("text")], part.column("label").to_pylist(), scale))
        weights, bias = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([(weights * scale).tobytes()]), pa.array([bias])], ["weights", "bias"])

    fitted = training.repartition(1).mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(fitted.weights)), fitted.bias)


def cross_validate(training: DataFrame, settings: list[tuple[float, float]], folds: int = 5) -> DataFrame:
    """smoothing, penalty, toxic, found, alarms and loss of each setting: learnt on all folds but one, tried on that one.

    ``SMOOTHING`` and ``PENALTY`` were chosen by this on rows that may be learnt from, and
    then frozen; held-out rows took no part.  Every setting and fold is a task of its own.
    """
    tries = F.array(*(F.struct(F.lit(s).alias("smoothing"), F.lit(p).alias("penalty"), F.lit(k).alias("out")) for s, p in settings for k in range(folds)))
    rows = training.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"), F.explode(tries).alias("t")).select("text", "label", "fold", "t.*")
    names = ["smoothing", "penalty", "toxic", "found", "alarms", "loss", "n"]

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        smoothing, penalty, out = (x.as_py() for x in key)
        slots, label, test = Slots(), np.array(group.column("label").to_pylist()), group.column("fold").to_numpy() == out
        found = [slots.counted(t.as_py()) for t in group.column("text")]
        sums = np.zeros((2, 1 << BITS))
        for (slot, value), y in zip([f for f, t in zip(found, test) if not t], label[~test]):
            sums[y][slot] += value / UNITS
        total, y = sums.sum(axis=1), label[test]
        if not test.any() or not total.all():
            return pa.table({n: pa.array([v]) for n, v in zip(names, [smoothing, penalty, int(y.sum()), 0, 0, 0.0, 0])})
        ratio = np.where(sums.any(axis=0), np.log((sums[1] + smoothing * total[1] / total.sum()) / total[1]) - np.log((sums[0] + smoothing * total[0] / total.sum()) / total[0]), 0.0)
        learnt = np.flatnonzero(~test)
        weights, bias = fit([Rows([found[i] for i in learnt[k : k + PIECE]], label[learnt[k : k + PIECE]].tolist(), ratio) for k in range(0, len(learnt), PIECE)], penalty)
        z = np.array([float(value @ (weights * ratio)[slot]) / UNITS + bias for (slot, value), t in zip(found, test) if t])
        loss = float(np.log1p(np.exp(-np.clip(np.where(y == 1, z, -z), -50, 50))).sum())
        return pa.table({n: pa.array([v]) for n, v in zip(names, [smoothing, penalty, int(y.sum()), int(((z >= 0) & (y == 1)).sum()), int(((z >= 0) & (y == 0)).sum()), loss, len(y)])})

    each = rows.groupBy("smoothing", "penalty", "out").applyInArrow(run, "smoothing double, penalty double, toxic long, found long, alarms long, loss double, n long")
    return each.groupBy("smoothing", "penalty").agg(F.sum("toxic").alias("toxic"), F.sum("found").alias("found"), F.sum("alarms").alias("alarms"), (F.sum("loss") / F.sum("n")).alias("loss"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, m = Slots(), shared.value
        for batch in batches:
            z = np.array([m.of(slots, t.as_py()) for t in batch.column("text")], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go.  Text and verdict share one pass."""
    shared = spark.sparkContext.broadcast(train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, m = Slots(), shared.value
        for batch in batches:
            keep = [m.of(slots, t.as_py()) < 0 for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
