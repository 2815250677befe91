"""Token ids in Re-Pair compressed shards with random access (operator 4).

Documents are ranged by doc_id; every task encodes its range in order and cuts
the ids into shards of about ``SHARD_TOKENS``.  In a shard frequent pairs of ids
are replaced by nonterminals (Re-Pair) until no pair occurs ``LEAST`` times: a rule
takes 12 bytes (two symbols and a length) and every use of it saves 4, so a rarer
pair gains nothing.  Pairs are replaced many at a time: at every place the locally
most frequent pair wins, and a pair whose wins fall below ``LEAST`` waits for a
later round.  No nonterminal crosses the end of a document.

A shard's record holds the rules, the number of ids every nonterminal expands to,
the remaining symbols and each document's number of ids.  Expansion lengths place
every symbol among the ids, so any span of ids (a document, say) is decoded from
its own symbols alone.

Records are binary columns of Parquet files in the shared folder.  A shard's
place in the whole corpus is its place in its range plus the ranges before it:
sums over ranges, of which there are as many as shuffle partitions.

Memory: a task holds one shard (and one document, if that is larger).

Edge cases: null and empty texts are the end id alone; rows with one doc_id are
ordered by their text and all written; a null doc_id comes first; extra columns
are left out; an empty table writes no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm.bpe import encoder, pieces, vocabulary_path
from sparkloom.llm.shared import small, stage

END_ID = 1
SHARD_TOKENS = 1 << 18
#: Fewest uses of a rule: four save 16 bytes and the rule takes 12.
LEAST = 4
#: Pairs are counted in so many slots by hash, exactly when there are few candidates.
_HASH_BITS = 18
_FEW = 1 << 15
#: Characters of a text that range partitioning sees, to part rows of one doc_id.
_PREFIX = 64


class Pairs:
    """The symbols of a shard as a linked list, with the places that may still start a frequent pair."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        n = len(ids)
        self.seq = np.append(ids, 0).astype(np.int32)
        self.right = np.minimum(np.arange(1, n + 2, dtype=np.int32), n)
        self.left = np.arange(-1, n, dtype=np.int32)
        self.left[0] = n
        self.last = np.zeros(n + 1, bool)  # symbols that end a document
        self.last[ends - 1] = True
        self.last[n] = True
        self.alive = np.ones(n, bool)
        self.rank = np.zeros(n + 1, np.int64)
        self.places = np.flatnonzero(~self.last).astype(np.int32)

    def count(self, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot of every place, which places count for their slot, and the slots' counts.

        Of a run of one symbol only every second place counts.  With hashed slots, pairs
        other than the one that represents their slot don't count.  Places whose slot is
        too rare are forgotten: no later replacement makes an old pair more frequent.
        """
        places = self.places
        a, b = self.seq[places], self.seq[self.right[places]]
        twin = np.flatnonzero(a == b)
        odd = twin[:0]
        if len(twin):
            at = places[twin]
            step = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.append(True, self.right[at[:-1]] != at[1:]), step, 0))
            odd = twin[(step - run) % 2 == 1]
        if exact:
            slot = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]
            size = int(slot.max()) + 1
        else:
            mixed = (a.view(np.uint32) * np.uint32(0x9E3779B1) ^ b.view(np.uint32) * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
            slot, size = (mixed >> np.uint32(32 - _HASH_BITS)).astype(np.int32), 1 << _HASH_BITS
        counts = np.bincount(slot, minlength=size)
        if len(odd):
            counts -= np.bincount(slot[odd], minlength=size)
        fine = np.ones(len(places), bool)
        fine[odd] = False
        hot = counts[slot] >= LEAST
        self.places, slot, fine = places[hot], slot[hot], fine[hot]
        if not exact:
            a, b = a[hot], b[hot]
            shown = np.zeros(size, np.int32)
            shown[slot] = np.arange(len(slot), dtype=np.int32)
            shown = shown[slot]
            fine &= (a[shown] == a) & (b[shown] == b)
            counts = np.bincount(slot[fine], minlength=size)
            fine &= counts[slot] >= LEAST
        return slot, fine, counts

    def replace(self, first: int, exact: bool) -> np.ndarray | None:
        """Replaces pairs by symbols from ``first`` on; the rules (left, right), or None if there are none."""
        slot, fine, counts = self.count(exact)
        places, slot = self.places[fine], slot[fine]
        mine = counts[slot].astype(np.int64) << 32 | slot
        self.rank[places] = mine
        wins = (mine >= self.rank[self.left[places]]) & (mine >= self.rank[self.right[places]])
        self.rank[places] = 0
        places, slot = places[wins], slot[wins]
        enough = np.bincount(slot, minlength=len(counts)) >= LEAST
        chosen = enough[slot]
        places, slot = places[chosen], slot[chosen]
        if not len(places):
            return None
        slots = np.flatnonzero(enough)
        number, at = np.zeros(len(counts), np.int32), np.zeros(len(counts), np.int32)
        number[slots], at[slot] = first + np.arange(len(slots)), places
        at = at[slots]
        rules = np.stack([self.seq[at], self.seq[self.right[at]]], axis=1)
        gone = self.right[places]
        after = self.right[gone]
        self.seq[places], self.last[places], self.alive[gone] = number[slot], self.last[gone], False
        self.right[places], self.left[after] = after, places
        # next candidates: those left over, and the places beside new symbols
        mark = np.zeros(len(self.seq), bool)
        mark[self.places] = mark[places] = mark[self.left[places]] = True
        mark[gone] = False
        self.places = np.flatnonzero(mark & ~self.last).astype(np.int32)
        return rules


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """First nonterminal, rules (left, right) and symbols.

    ``ends`` holds the place after every document's last id; a pair is only taken
    if its left symbol doesn't end a document.
    """
    base = int(ids.max(initial=0)) + 1
    pairs, rules, made, exact = Pairs(ids, ends), [np.zeros((0, 2), np.int32)], 0, False
    while len(pairs.places):
        exact = exact or len(pairs.places) < _FEW
        found = pairs.replace(base + made, exact)
        if found is not None:
            rules.append(found)
            made += len(found)
        elif exact:
            break
        exact = found is None  # hashed slots hid what is left: count it exactly
    return base, np.concatenate(rules), pairs.seq[:-1][pairs.alive]


def expansion_lengths(table: np.ndarray, base: int) -> np.ndarray:
    """Ids that every nonterminal stands for; rules only name earlier ones."""
    size = np.ones(base + len(table), np.int64)
    done = 0
    while done < len(table):  # rules of one round don't name each other
        high = table[done:].max(axis=1).astype(np.int64) - base
        blocked = np.flatnonzero(np.maximum.accumulate(high) >= done)
        stop = done + int(blocked[0]) if len(blocked) else len(table)
        size[base + done : base + stop] = size[table[done:stop, 0]] + size[table[done:stop, 1]]
        done = stop
    return size[base:]


class Shard:
    """The columns of a record as arrays."""

    def __init__(self, record: dict):
        self.base = record["base"]
        self.table = np.frombuffer(record["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(record["lengths"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(record["symbols"], "<u4")
        self.doc_tokens = np.array(record["doc_tokens"], np.int64)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        high = symbols >= self.base
        out[high] = self.lengths[symbols[high] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of any run of symbols: lengths say where the two sides of a rule go."""
        size = self.sizes(symbols)
        stop = np.cumsum(size)
        out = np.zeros(int(size.sum()), np.uint32)
        at = stop - size
        out[at] = symbols
        at = at[symbols >= self.base]
        while len(at):
            rule = self.table[out[at] - self.base]
            left, right = rule[:, 0], rule[:, 1]
            beside = at + self.sizes(left)
            out[at], out[beside] = left, right
            at = np.concatenate([at[left >= self.base], beside[right >= self.base]])
        return out

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard: only the symbols that cover them are expanded."""
        ends = np.cumsum(self.sizes(self.symbols))
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - before : stop - before]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        stop = int(self.doc_tokens[: k + 1].sum())
        return self.span(stop - int(self.doc_tokens[k]), stop)


SHARDS = "part int, first long, n long, doc_ids array<{id}>, doc_tokens array<long>, base long, rules binary, lengths binary, symbols binary"


def _record(part: int, first: int, doc_ids: list, counts: list[int], packed: list[np.ndarray]) -> dict:
    ids = np.concatenate(packed)
    base, table, symbols = compress(ids, np.cumsum(counts))
    return {
        "part": part, "first": first, "n": len(ids), "doc_ids": doc_ids, "doc_tokens": counts, "base": base, "rules": table.astype("<u4").tobytes(),
        "lengths": expansion_lengths(table, base).astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(),
    }


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Shards of all documents (doc_id, text) in ascending order of doc_id, not yet written."""
    path = path or vocabulary_path()
    kind = dict(docs.dtypes)["doc_id"]
    schema = docs.sparkSession.createDataFrame([], SHARDS.format(id=kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        bpe, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        first, doc_ids, counts, packed, held = 0, [], [], [], 0
        for batch in pieces(batches):
            found, count = bpe.encode_array(batch.column("text").to_pylist())
            stop = np.cumsum(count).tolist()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), [0, *stop], stop):
                if held and held + b - a + 1 > SHARD_TOKENS:
                    yield pa.RecordBatch.from_pylist([_record(part, first, doc_ids, counts, packed)], schema=arrow)
                    first, doc_ids, counts, packed, held = first + held, [], [], [], 0
                doc_ids.append(doc_id)
                counts.append(b - a + 1)
                packed += [found[a:b], end]
                held += b - a + 1
        if held:
            yield pa.RecordBatch.from_pylist([_record(part, first, doc_ids, counts, packed)], schema=arrow)

    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = ranged.repartitionByRange(F.col("doc_id"), F.substring("text", 1, _PREFIX))
    return ranged.sortWithinPartitions("doc_id", "text").mapInArrow(run, schema)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards alone."""
    sums = stage(shards.groupBy("part").agg(F.sum("n").alias("n")), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(stage(sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("offset")), "token-offsets"), 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, record in enumerate(batch.drop_columns("doc_ids").to_pylist()):
                shard = Shard(record)
                ids = shard.expand(shard.symbols).astype("<u4").tobytes()
                stop = np.cumsum(shard.doc_tokens)
                start = stop - shard.doc_tokens
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids").slice(k, 1).flatten(), pa.array(record["first"] + record["offset"] + start), pa.array(shard.doc_tokens), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    placed = shards.join(offsets, "part").select("first", "offset", "doc_ids", "doc_tokens", "base", "rules", "lengths", "symbols")
    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to compressed shards and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(stage(write_shards(docs), "token-files", compression="zstd"))
