"""Removal of repeated substrings by suffix arrays (operator 3).

Every byte inside a string of ``LENGTH`` bytes that also starts elsewhere goes.

* **Dealing out.** Of each window of LENGTH bytes the ``GRAM``-byte gram with the
  smallest hash is its anchor.  Equal windows have equal anchors at equal places,
  so all places where a window can repeat meet under one anchor hash.  The windows
  of one anchor are a *segment* of the text, 200 to 368 bytes.
* **Candidates.** Only segments whose anchor occurs twice or more go on; equal
  segments (by hash of anchor and of content) are kept once with their number.
* **Suffix arrays.** A task sorts the suffixes of all its segments in two stages
  (see ``suffixes``) and compares neighbours; windows whose neighbour shares
  LENGTH bytes, byte for byte, repeat.  An anchor with more than MANY_SEGMENTS
  different segments is first split by the bytes about the anchor (``split_groups``),
  so the suffixes of a group are always one task's work.
* **Removal.** Repeated windows become byte ranges of every document that has the
  segment; their union is cut out.

Texts are moved only for documents that a bounded bitmap cannot rule out: once
for those that show a segment's bytes, once for those that lose bytes.

Edge cases: null and empty texts lose nothing; a text shorter than LENGTH has no
window; rows that share a doc_id are told apart by a row number and each have their
own result; a null doc_id is a row like any other; bytes are those of
UTF-8, and what is left need not be valid UTF-8 (it is returned as binary); extra
columns are left out; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.filters import bitmap_of, marked
from sparkloom.llm.shared import stage
from sparkloom.llm.suffixes import _INVERSE, _ODD, repeated_windows, window_hashes

LENGTH = 200
GRAM = 32
#: Bytes of segments whose suffixes are sorted together.
SORT_BYTES = 3_000_000
#: Segments of one anchor whose suffixes are sorted together; more are split by their bytes first.
MANY_SEGMENTS = 2_000
#: Bytes of a text whose anchors are searched at a time (places take 24 bits).
PART_BYTES = 1 << 22
HASH_BITS, DOC_BITS = 27, 26
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the GRAM bytes from every place, by doubling."""
    h, n, power = data.astype(np.uint64) + np.uint64(1), 1, 0x100000001B3
    while n < GRAM:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power & (1 << 64) - 1, 2 * n
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, start and length of every segment of a text."""
    found = []
    for base in range(0, max(len(data) - LENGTH + 1, 0), PART_BYTES):
        part = data[base : base + PART_BYTES + LENGTH - 1]
        h = gram_hashes(part)
        low = sliding_minimum((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        after = np.append(first[1:], len(low)) + LENGTH - 1
        total = np.append(np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(len(part), _ODD), dtype=np.uint64))
        content = (total[after] - total[first]) * _powers(len(part), _INVERSE)[first]
        found.append((h[(low[first] & _LOW).astype(np.int64)], content, first + base, after - first))
    if not found:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64; the longest table is kept (PART_BYTES at most)."""
    if len(_POWERS.get(int(base), ())) < n:
        size = min(max(1 << 17, 1 << (n - 1).bit_length()), PART_BYTES + LENGTH)
        _POWERS[int(base)] = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(size, n) - 1, base)))
    return _POWERS[int(base)][:n]


def _bytes_of(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer() or b"", np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def occurrences(docs: DataFrame) -> DataFrame:
    """anchor, content, key, start, size of every segment of every text; docs: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = batch.column("key").to_pylist(), [segments(_bytes_of(t)) for t in batch.column("text")]
            for k in range(0, len(parts), 500):
                some = parts[k : k + 500]
                number = [len(p[0]) for p in some]
                anchor, content, start, size = (np.concatenate(x) for x in zip(*some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(np.repeat(keys[k : k + 500], number), pa.int64()), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int16))],
                    ["anchor", "content", "key", "start", "size"],
                )

    return docs.mapInArrow(run, "anchor long, content long, key long, start int, size short")


def cut_segments(docs: DataFrame, shown: DataFrame, placed: bool = False) -> DataFrame:
    """anchor, content, n, bytes: the bytes of every segment at the place that shows it.

    Only texts that may show one of these segments are dealt.  ``placed`` adds ``at``,
    where in its bytes a segment's anchor lies: here, as a second pass over Arrow
    batches in the same stage would hold a second Python process a core.
    """
    showing = marked(docs, "key", bitmap_of(shown, "key", DOC_BITS), DOC_BITS).where("maybe").drop("maybe")
    wanted = shown.groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "n", "start", "size")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, w in zip(batch.column("text"), batch.column("w")):
                raw, rows = _bytes_of(text), w.values
                start, size = rows.field("start").to_numpy(), rows.field("size").to_numpy().astype(np.int64)
                body = [raw[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())]
                out = pa.RecordBatch.from_arrays([rows.field("anchor"), rows.field("content"), rows.field("n"), pa.array(body, pa.binary())], ["anchor", "content", "n", "bytes"])
                if placed:
                    anchors = rows.field("anchor").to_numpy().view(np.uint64)
                    at = [int(np.argmax(gram_hashes(raw[a : a + n]) == h)) for a, n, h in zip(start.tolist(), size.tolist(), anchors)]
                    out = out.append_column("at", pa.array(at, pa.int32()))
                yield out

    return showing.join(wanted, "key").select("text", "w").mapInArrow(run, "anchor long, content long, n long, bytes binary" + ", at int" * placed)


def repeated_ranges(cut: DataFrame) -> DataFrame:
    """anchor, content, froms, tos: byte ranges of each segment that repeat; cut: grp, anchor, content, n, bytes.

    The segments of a group are compared with each other.
    """

    def sort(held: list[tuple]) -> pa.RecordBatch:
        strings = [h[4] for h in held]
        masks = repeated_windows(strings, np.array([h[3] > 1 for h in held]), LENGTH)
        out: list[tuple] = []
        for (_, anchor, content, _, _), mask in zip(held, masks):
            if mask.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                out.append((anchor, content, edge[::2].tolist(), (edge[1::2] + LENGTH - 1).tolist()))
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "content", "froms", "tos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}  # a segment of several groups is sorted once
        size, group = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "anchor", "content", "n", "bytes"))):
                if size >= SORT_BYTES and row[0] != group:
                    yield sort(list(held.values()))
                    held, size = {}, 0
                group = row[0]
                if row[1:3] not in held:
                    held[row[1:3]] = row
                    size += len(row[4])
        if held:
            yield sort(list(held.values()))

    dealt = cut.select("grp", "anchor", "content", "n", "bytes").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "anchor long, content long, froms array<int>, tos array<int>")


def _shared(mine: Callable[[Column, Column], Column], other: Callable[[Column, Column], Column], most: Column) -> Column:
    """How many bytes (``most`` at most, 255 in all) two segments share: bytes ``from`` on, ``n`` of them, are asked for by halves."""
    steps = F.array(*(F.lit(1 << k) for k in range(7, -1, -1)))
    grow = lambda n, step: F.when((n + step <= most) & (mine(n, step) == other(n, step)), n + step).otherwise(n)
    return F.aggregate(steps, F.lit(0), grow)


def split_groups(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits crowded anchors; cut: anchor, content, n, bytes, at of all their segments.

    Gives groups (grp, anchor, content, n, bytes) of at most MANY_SEGMENTS whose
    windows are still to be compared, and ranges (anchor, content, froms, tos) known
    to repeat.  All segments of a group share L bytes before the anchor and R after
    it, compared byte by byte with one of them.  If that makes LENGTH bytes, all
    windows inside repeat, and any other window that two of them share goes on by at
    least one shared byte to the left or to the right.  If not, a shared window needs
    half of the missing bytes on one side.  Either way a segment joins one group by its
    bytes to the left and one by those to the right, until groups are small.
    """
    rows = stage(cut.withColumn("grp", F.col("anchor")), "substring-crowded-0")
    whole = rows.where("n > 1").select("anchor", "content", F.array(F.lit(0)).alias("froms"), F.array(F.length("bytes")).alias("tos"))
    groups, known = rows.limit(0).drop("at"), whole
    span = LENGTH - GRAM
    after = F.length("bytes") - F.col("at") - GRAM
    while True:
        sizes = stage(rows.groupBy("grp").count().where("count > 1"), "substring-groups")
        calm, crowded = sizes.where(F.col("count") <= MANY_SEGMENTS), sizes.where(F.col("count") > MANY_SEGMENTS)
        groups = groups.unionByName(rows.join(calm, "grp", "left_semi").drop("at"))
        if crowded.isEmpty():
            return groups, known
        many = rows.join(crowded.select("grp"), "grp", "left_semi")
        head = many.groupBy("grp").agg(F.min(F.struct("content", F.col("at").alias("at2"), F.col("bytes").alias("bytes2"))).alias("h"))
        pairs = many.join(stage(head.select("grp", "h.at2", "h.bytes2"), "substring-heads"), "grp")
        left = _shared(lambda n, k: F.substring("bytes", F.col("at") - n - k + 1, k), lambda n, k: F.substring("bytes2", F.col("at2") - n - k + 1, k), F.least("at", "at2"))
        right = _shared(lambda n, k: F.substring("bytes", F.col("at") + GRAM + n + 1, k), lambda n, k: F.substring("bytes2", F.col("at2") + GRAM + n + 1, k),
                        F.least(after, F.length("bytes2") - F.col("at2") - GRAM))
        bounds = pairs.select("grp", left.alias("l"), right.alias("r")).groupBy("grp").agg(F.min("l").alias("l"), F.min("r").alias("r"))
        many = many.join(stage(bounds, "substring-bounds"), "grp").withColumn("missing", F.lit(span) - F.col("l") - F.col("r"))
        inside = many.where("missing <= 0").select("anchor", "content", F.array(F.col("at") - F.col("l")).alias("froms"), F.array(F.col("at") + GRAM + F.col("r")).alias("tos"))
        known = known.unionByName(stage(inside, "substring-known"))
        more_left = F.when(F.col("missing") > 0, F.ceil(F.col("missing") / 2).cast("int")).otherwise(1)
        more_right = F.when(F.col("missing") > 0, F.floor(F.col("missing") / 2).cast("int") + 1).otherwise(1)
        ways = F.array(F.struct((F.col("l") + more_left).alias("l"), "r"), F.struct("l", (F.col("r") + more_right).alias("r")))
        next_ = many.withColumn("w", F.explode(ways)).where((F.col("at") >= F.col("w.l")) & (after >= F.col("w.r")))
        key = F.xxhash64("anchor", "w.l", "w.r", F.substring("bytes", F.col("at") - F.col("w.l") + 1, F.col("w.l") + GRAM + F.col("w.r")))
        rows = next_.withColumn("grp", key).select("anchor", "content", "n", "bytes", "at", "grp").dropDuplicates(["grp", "content"])
        rows = stage(rows, "substring-crowded")


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[new], reach[np.append(new[1:], len(start)) - 1]


def remove(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """key, n_bytes, starts, stops and rest (binary) of every text; ranges: key, r (list of from, to)."""
    ranges = ranges.alias("r")
    bitmap = bitmap_of(ranges, "key", DOC_BITS)
    some = marked(docs, "key", bitmap, DOC_BITS)
    none = F.array().cast("array<struct<f:int,t:int>>")
    touched = some.where("maybe").drop("maybe").join(ranges, "key", "left").select("key", "text", F.coalesce("r", none).alias("r"))
    clean = some.where("not maybe").select("key", "text", none.alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, r in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("r")):
                raw = _bytes_of(text)
                if len(r.values):
                    a, b = merged(r.values.field("f").to_numpy().astype(np.int64), r.values.field("t").to_numpy().astype(np.int64))
                    rest = b"".join(raw[i:j].tobytes() for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
                else:
                    a = b = np.zeros(0, np.int64)
                    rest = raw.tobytes()
                out.append((key, len(raw), a.tolist(), b.tolist(), rest))
                if len(out) == 500:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "n_bytes", "starts", "stops", "rest"])

    schema = "key long, n_bytes long, starts array<int>, stops array<int>, rest binary"
    return touched.mapInArrow(run, schema).unionByName(clean.mapInArrow(run, schema))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """key, n_bytes, starts, stops, rest of every row; docs: key (a distinct long for every row), text."""
    docs = docs.select("key", "text")
    every = stage(occurrences(docs), "substring-occurrences", compression="zstd")
    again = stage(every.groupBy("anchor").count().where("count > 1").select("anchor"), "substring-anchors")
    bitmap = stage(bitmap_of(again, "anchor", HASH_BITS), "substring-bitmap")
    candidates = marked(every, "anchor", bitmap, HASH_BITS).where("maybe").drop("maybe")
    place = F.min(F.struct("key", "start", "size"))
    shown = candidates.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), place.alias("p"))
    shown = stage(shown.join(again, "anchor", "left_semi").select("anchor", "content", "n", "p.key", "p.start", "p.size"), "substring-shown")
    crowded = stage(shown.groupBy("anchor").count().where(F.col("count") > MANY_SEGMENTS).select("anchor"), "substring-crowded")
    calm = shown.join(crowded, "anchor", "left_anti")
    groups = cut_segments(docs, calm).withColumn("grp", F.col("anchor"))
    if crowded.isEmpty():
        found = repeated_ranges(groups)
    else:
        split, known = split_groups(cut_segments(docs, shown.join(crowded, "anchor", "left_semi"), placed=True))
        found = repeated_ranges(groups.unionByName(split)).unionByName(known)
    repeats = stage(found, "substring-repeats")
    hits = candidates.join(repeats, ["anchor", "content"])
    pairs = F.arrays_zip("froms", "tos")
    hits = hits.select("key", F.transform(pairs, lambda p: F.struct((p["froms"] + F.col("start")).alias("f"), (p["tos"] + F.col("start")).alias("t"))).alias("r"))
    ranges = stage(hits.groupBy("key").agg(F.flatten(F.collect_list("r")).alias("r")), "substring-ranges")
    return remove(docs, ranges)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, key, text; key is doc_id where that is a distinct number for every row."""
    docs = docs.select("doc_id", "text")
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("m")).first()
    twice = got.n != got.m or not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if not twice:
        return docs.withColumn("key", F.col("doc_id").cast("long")), False
    return stage(docs.withColumn("key", F.monotonically_increasing_id()), "substring-keyed"), True


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    docs, own_keys = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = substring_dedup(docs)
    removed = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)
    out = out.select("key", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))
    if own_keys:
        return out.join(docs.select("doc_id", "key"), "key").drop("key")
    return out.withColumnRenamed("key", "doc_id")
