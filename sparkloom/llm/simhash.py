"""SimHash near-duplicates by vantage-point trees over fingerprints (operator 10).

Fingerprints of at most ``RADIUS`` differing bits are linked.  The 64 bits are
cut into ``BLOCKS`` blocks; two linked fingerprints differ in at most
``RADIUS // BLOCKS`` = 1 bit of at least one block, so one tree a block, with the
Hamming distance on that block as its metric and a search radius of one, finds
every link:

* A tree's level deals fingerprints by their distance to its vantage point; the
  distances of all ``LEVELS`` levels are a shard.  Every fingerprint is at home in
  one shard of each tree.
* By the triangle inequality, codes at distance one have distances to a vantage
  point that differ by at most one (here by exactly one), so a search visits a
  shard's neighbours only and prunes all other branches.  A fingerprint is sent to
  the boundary shards that one changed bit of its code can reach; as such a change
  flips the parity of a code, it is enough that odd codes visit even ones.
* In a shard home and visiting fingerprints are compared on all 64 bits.  Small
  shards emit their links, larger ones a spanning forest of them: every connected
  member is linked once, so groups of copies stay linear.

One tree on all 64 bits with a radius of four would be right but prunes next to
nothing: distances of 64 random bits lie within 32 +- 4, so more than half of
all pairs pass each triangle bound.

A shard of more than ``SHARD_ROWS`` fingerprints is cut into tiles and each pair
of tiles becomes a shard of its own, so one dense group never fills a task.
Equal fingerprints are one node from the start.

Edge cases: null and empty texts, and texts of blanks only, have fingerprint
zero and are linked with each other like any others; fewer words than a shingle
give the whole sequence as the only shingle; rows with one id are reported each
with its own text's fingerprint and component; null ids are nodes like others
(their component is null if only null ids are in it); extra columns are left out
of the result, and kept by ``one_of_each``; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.llm.filters import without
from sparkloom.llm.shared import small, stage, unused

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Trees: with RADIUS // BLOCKS = 1 a search radius of one bit in a block is enough.
BLOCKS = 3
#: Vantage points of a tree, one a level; ten distances (of 5 bits each) tell nearly all codes of a block apart.
LEVELS = 10
#: Fingerprints of one shard before it is cut into tiles.
SHARD_ROWS = 4_096
#: Rows of a group of shards that are handed to Python together, on average.
GROUP_ROWS = 50_000
#: Shards of up to so many rows emit all their links.
SMALL_SHARD = 16
#: Hashes summed at a time.
SLICE = 1 << 15
#: Bits of the filter of dropped rows in the pipeline (8 MB).
DROP_BITS = 26


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    last = max(len(words) - shingle, 0)
    ends = end[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    starts = start[: last + 1].tolist()
    for k in range(0, last + 1, SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + SLICE], ends[k : k + SLICE])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > last + 1, bitorder="little").view("<u8")[0])


def fingerprint_column(rows: DataFrame, text_col: str, shingle: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("__text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], [*keep, "__fp"])

    given = rows.select(*keep, F.col(text_col).alias("__text"))
    schema = given.drop("__text").withColumn("__fp", F.lit(0).cast("long")).schema
    return given.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp: the fingerprint of every row as a signed long."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return fingerprint_column(named, "text", shingle, ["id"]).withColumnRenamed("__fp", "fp")


def blocks(count: int = BLOCKS) -> list[tuple[int, int]]:
    """First bit and width of every block."""
    cuts = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def vantage(tree: int, level: int, width: int) -> int:
    """The vantage point of a tree's level: fixed pseudo-random bits."""
    return xxhash.xxh64_intdigest(f"{tree}:{level}", 7) & ((1 << width) - 1)


def shard_of(tree: int, width: int, code: Column) -> Column:
    """The distances of a code to all vantage points of a tree, in one number."""
    out = F.lit(tree).cast("long")
    for level in range(LEVELS):
        out = F.shiftleft(out, 5) + F.bit_count(code.bitwiseXOR(F.lit(vantage(tree, level, width))))
    return out


def code_of(first: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), first).bitwiseAND(F.lit((1 << width) - 1))


def visits(nodes: DataFrame) -> DataFrame:
    """fp, shard and home (false: visiting) of every fingerprint in every tree."""
    out = None
    for tree, (first, width) in enumerate(blocks()):
        code = F.col("code")
        at = nodes.select("fp", code_of(first, width).alias("code"))
        flips = F.array(*(code.bitwiseXOR(F.lit(1 << b)) for b in range(width)))
        reached = F.when(F.bit_count(code) % 2 == 1, F.array_distinct(F.transform(flips, lambda c: shard_of(tree, width, c)))).otherwise(F.array().cast("array<long>"))
        goes = F.concat(F.array(F.struct(shard_of(tree, width, code).alias("shard"), F.lit(True).alias("home"))),
                        F.transform(reached, lambda s: F.struct(s.alias("shard"), F.lit(False).alias("home"))))
        part = at.select("fp", F.explode(goes).alias("g")).select("fp", "g.shard", "g.home")
        out = part if out is None else out.unionByName(part)
    return out


def crowded(nodes: DataFrame) -> DataFrame:
    """shard, tiles of the shards that may hold more than SHARD_ROWS rows.

    Codes are counted first.  A shard's rows come from its own codes and from those one
    bit away, at most 23 kinds for codes that the levels tell apart; codes with few
    fingerprints can only fill it together with one that has SHARD_ROWS / 32 or more,
    so it is enough to add up what those send, and a share for all the others.
    """
    out = None
    for tree, (first, width) in enumerate(blocks()):
        often = nodes.select(code_of(first, width).alias("code")).groupBy("code").count().where(F.col("count") >= SHARD_ROWS // 32)
        reach = F.array(F.col("code"), *(F.col("code").bitwiseXOR(F.lit(1 << b)) for b in range(width)))
        part = often.select(F.explode(F.array_distinct(F.transform(reach, lambda c: shard_of(tree, width, c)))).alias("shard"), "count")
        out = part if out is None else out.unionByName(part)
    rows = F.sum("count") + SHARD_ROWS
    found = out.groupBy("shard").agg(F.ceil(rows * 2 / SHARD_ROWS).cast("int").alias("tiles"))
    return stage(found, "simhash-crowded")


def dealt(nodes: DataFrame, count: int) -> DataFrame:
    """group, shard, fp, home: visits with crowded shards cut into pairs of tiles, dealt into groups of shards."""
    tiles = small(crowded(nodes), 100_000)
    rows = visits(nodes).join(tiles, "shard", "left")
    tile = F.pmod(F.xxhash64("fp", "shard"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.xxhash64("shard", F.least(tile, o), F.greatest(tile, o)))
    rows = rows.withColumn("shard", F.explode(F.when(F.col("tiles").isNull(), F.array("shard")).otherwise(pairs))).drop("tiles")
    width = sum(1 + w / 2 for _, w in blocks())
    groups = max(1, round(count * width / GROUP_ROWS))
    return rows.select(F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("group"), "shard", "fp", "home")


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of a spanning forest of the links among ``fp``.

    Breadth first against the members not reached yet, which shrink as they are reached.
    """
    left = np.arange(len(fp))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    front = left[:0]
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
        now, front = front[:128], front[128:]
        near = np.bitwise_count(fp[now][:, None] ^ fp[left][None, :]) <= radius
        hit = near.any(axis=0)
        if hit.any():
            a.append(now[near[:, hit].argmax(axis=0)])
            b.append(left[hit])
            front = np.concatenate([front, left[hit]])
            left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def linked(fp: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Positions with any link to a fingerprint at home, by blocks of the distance matrix."""
    out = np.zeros(len(fp), bool)
    at_home = np.flatnonzero(home)
    for k in range(0, len(at_home), 256):
        rows = at_home[k : k + 256]
        near = np.bitwise_count(fp[rows][:, None] ^ fp[None, :]) <= radius
        near[np.arange(len(rows)), rows] = False
        out |= near.any(axis=0)
        out[rows] |= near.any(axis=1)
    return np.flatnonzero(out)


def shard_links(shard: np.ndarray, fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints (a, b) of many shards; a shard's links are connected as all its links would be."""
    order = np.argsort(shard, kind="stable")
    shard, fp, home = shard[order], fp[order], home[order]
    start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    size = np.diff(np.append(start, len(shard)))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    rows = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL_SHARD), size))
    for shift in range(1, SMALL_SHARD):  # small shards side by side: every row and the one ``shift`` later
        rows = rows[rows + shift < len(shard)]
        rows = rows[shard[rows] == shard[rows + shift]]
        if not len(rows):
            break
        near = (np.bitwise_count(fp[rows] ^ fp[rows + shift]) <= radius) & (home[rows] | home[rows + shift])
        a.append(fp[rows[near]])
        b.append(fp[rows[near] + shift])
    for k in np.flatnonzero(size > SMALL_SHARD).tolist():
        part, own = fp[start[k] : start[k] + size[k]], home[start[k] : start[k] + size[k]]
        part = part[linked(part, own, radius)]
        x, y = forest(part, radius)
        a.append(part[x])
        b.append(part[y])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(nodes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """a, b: links that connect all fingerprints (fp, distinct) within ``radius``."""
    if radius // BLOCKS > 1:
        raise ValueError(f"{BLOCKS} trees of search radius one find links of up to {2 * BLOCKS - 1} bits")

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        x, y = shard_links(
            group.column("shard").to_numpy(), group.column("fp").to_numpy().view(np.uint64), group.column("home").to_numpy(), radius
        )
        return pa.table({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})

    return dealt(nodes, count).groupBy("group").applyInArrow(run, "a long, b long")


def named(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id of every fingerprint; prints: id, fp."""
    nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("node")), "simhash-nodes")
    found = components(links(nodes.select("fp"), nodes.count(), radius)).withColumnRenamed("node", "fp")
    joined = stage(nodes.join(found, "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("component")), "simhash-joined")
    least = joined.groupBy("component").agg(F.min("node").alias("component_id"))
    return joined.join(least, "component").select("fp", "component", "component_id")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """id, fp and component_id (smallest id reachable) of every row."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    return prints.join(named(prints, radius).select("fp", "component_id"), "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest id stays (ids before nulls, then the first row).

    Decisions are by row, not by id: of repeated rows one stays, and texts that share
    an id are decided each by its own component.
    """
    columns, row = docs.columns, unused(docs, "__row")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    prints = fingerprint_column(docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), "text"), "text", SHINGLE, ["row", "id"])
    prints = stage(prints.withColumnRenamed("__fp", "fp"), "simhash-prints")
    rows = prints.join(named(prints).select("fp", "component"), "fp")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row"))
    dropped = stage(prints.join(stage(first, "simhash-first"), "row", "left_anti").select("row"), "simhash-dropped")
    return without(docs, row, dropped.select(F.col("row").alias(row)), DROP_BITS).select(columns)
