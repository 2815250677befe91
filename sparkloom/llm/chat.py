r"""Chat formatting at token level, with loss masks (operator 8).

A turn reads ``### role: text</turn>`` and a line end.  Its parts are encoded
separately and joined: a reserved id opens the turn, the role's ids follow, a
reserved id stands for the colon, the text's ids follow, a reserved id closes.
Reserved ids lie above the vocabulary, so no text can produce them.  In role and
text a backslash is put before ``\``, ``###``, ``: `` and ``</turn>``; taking
each backslash away again restores them.

The mask of a turn is the running sum of +1 where a loss part begins and -1 where
it ends; the loss parts are the texts of the roles in ``LOSS_ROLES``.  Places in
the conversation are running sums of the turns' lengths.

Turns are dealt out by ranges of (conversation, turn, role, first characters of the
text), so a long conversation is encoded by many tasks; a turn's place is its place
in its range plus the conversation's ids in the ranges before it.  Digests of whole
conversations are sequential by nature: they are read in order, turn by turn, in
constant memory.

Edge cases: null texts and roles count as empty; rows of one conversation and
turn are ordered by role, then text, and all kept; a null conv_id is one
conversation of its own, null turns come first; extra columns are left out; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.shared import stage

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLES = frozenset({"assistant"})
_CONTROL = re.compile(r"\\|###|: |</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class ChatCodec:
    """Byte-level encoder with three reserved ids above its vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._enc = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        base = max(ranks.values()) + 2  # one id is left free for an end-of-text token
        self.open, self.colon, self.close = base, base + 1, base + 2
        self._roles: dict[str, np.ndarray] = {}
        self._marks = {self.open: OPEN, self.colon: COLON, self.close: CLOSE}

    def encode(self, text: str) -> list[int]:
        return self._enc.encode_ordinary(text)

    def plain(self, ids: list[int]) -> str:
        return self._enc.decode_bytes(ids).decode("utf-8")

    def role(self, role: str) -> np.ndarray:
        """Ids from a turn's start to its text; those of short roles are remembered."""
        ids = self._roles.get(role)
        if ids is None:
            ids = np.array([self.open, *self.encode(escape(role)), self.colon], np.int32)
            if len(role) <= 40 and len(self._roles) < 1000:
                self._roles[role] = ids
        return ids

    def assemble_many(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and masks of turns, one after another, and the end of each."""
        close = np.array([self.close], np.int32)
        parts: list[np.ndarray] = []
        for role, text in zip(roles, texts):
            parts += [self.role(role), self._enc.encode_to_numpy(escape(text), disallowed_special=()).astype(np.int32), close]
        place = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
        learnt = np.flatnonzero([r in LOSS_ROLES for r in roles])
        delta = np.zeros(place[-1] + 1, np.int8)
        np.add.at(delta, place[3 * learnt + 1], 1)
        np.add.at(delta, place[3 * learnt + 2], -1)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return ids, np.cumsum(delta[:-1], dtype=np.int8), place[3::3]

    def assemble(self, role: str, text: str) -> tuple[list[int], list[int]]:
        """Ids of a turn and its mask."""
        ids, mask, _ = self.assemble_many([role], [text])
        return ids.tolist(), mask.tolist()

    def text_of(self, ids: list[int]) -> str:
        """The formatted text of any ids, reserved ones as their marks."""
        out, run = [], []
        for i in ids:
            if i in self._marks:
                out += [self.plain(run), self._marks[i]]
                run = []
            else:
                run.append(i)
        return "".join([*out, self.plain(run)])

    def parse(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of a turn's ids."""
        at = ids.index(self.colon)
        return unescape(self.plain(ids[1:at])), unescape(self.plain(ids[at + 1 : -1]))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ChatCodec:
    return ChatCodec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def format_turns(turns: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """conv_id, turn, role, text become conv_id, start (place in the conversation), ids and mask, written to the shared folder."""
    vocabulary = vocabulary or default_vocabulary()
    kind = dict(turns.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, part, now, at = codec(*vocabulary), TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            ids, masks, ends = chat.assemble_many([r or "" for r in batch.column("role").to_pylist()], [t or "" for t in batch.column("text").to_pylist()])
            sizes, place = np.diff(np.append(0, ends)).tolist(), []
            for conv_id, n in zip(batch.column("conv_id").to_pylist(), sizes):
                at = at if conv_id == now else 0
                now = conv_id
                place.append(at)
                at += n
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(masks)), pa.array(sizes, pa.int64()), pa.array(place, pa.int64()), pa.array([part] * len(sizes), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "ids", "mask", "n", "place", "part"])

    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = turns.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    made = stage(ranged.mapInArrow(run, f"conv_id {kind}, ids array<int>, mask array<tinyint>, n long, place long, part int"), "chat-turns", compression="zstd")
    # conversations that go on from one range into the next: at most one a range
    sums = made.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.sum("n").over(before)).where("before is not null")
    cut = F.broadcast(stage(cut.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before"), "chat-cuts"))
    joined = made.join(cut, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0).cast("long"))).alias("start"), "ids", "mask")


class _Conversation:
    def __init__(self, conv_id: Any):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, chat: ChatCodec, ids: list[int], mask: np.ndarray) -> None:
        role, text = chat.parse(ids)
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode())
        self.chars += len(chat.text_of(ids))
        learnt = np.asarray(ids)[mask.astype(bool)].tolist()
        if learnt:
            loss = unescape(chat.plain(learnt))
            self.loss_chars += len(loss)
            self.loss.update(loss.encode())

    def row(self) -> list[Any]:
        return [self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


def read_back(formatted: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Digests of every conversation from its formatted turns, read in order."""
    vocabulary = vocabulary or default_vocabulary()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, now, rows = codec(*vocabulary), None, []
        for batch in batches:
            for conv_id, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask")):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        rows.append(now.row())
                    now = _Conversation(conv_id)
                now.add(chat, ids.values.to_pylist(), mask.values.to_numpy())
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
                rows = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, now.row()))], schema=schema)

    schema = pa.schema([("conv_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""All conversations, and one whose texts hold control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.unionByName(extra)))
