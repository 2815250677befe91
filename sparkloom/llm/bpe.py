"""BPE encoding and decoding by forced-boundary splitting (operator 1).

A vocabulary token is a byte string.  If the byte pair ``xy`` occurs inside no
token, no merge can ever join ``x`` to ``y``: the place between them is a
*certain* cut.  Words are cut at all such places, the fragments are encoded
independently (and remembered, since fragments repeat far more often than words)
and the ids are concatenated.  This gives the ids of the full merge procedure.

The work is one narrow pass over the rows: no shuffle, state per worker bounded
by ``CACHE_ENTRIES``, and any lost partition can be recomputed alone.

Edge cases: a null or empty text encodes to no ids and decodes to the empty
string; extra columns are passed through by the DataFrame operators, and the
output columns replace input columns of the same name; repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of each per-worker memo; a full memo gives way, so memory is bounded.
CACHE_ENTRIES = 400_000
#: Chunks and words longer than this are never remembered.
CACHE_CHARS = 40
#: Fragments up to this many bytes use the list algorithm, longer ones a heap.
SHORT = 48
#: Characters of the texts whose new words are merged side by side.
MANY_CHARS = 5_000_000
_TABLE_BITS = 18
_TABLE_MASK = np.uint64((1 << _TABLE_BITS) - 1)
_MULTIPLIER = np.int64(0x1E3779B97F4A7C15)

_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
END_OF_WORD = "</w>"


def separated(text: str) -> bool:
    """Whether a text has separators that Python takes for blanks and the library does not."""
    return any(c in text for c in _SEPARATORS)


def latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies, to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def young_characters(path: str) -> tuple[frozenset[str], dict[int, str]]:
    """Characters younger than this Python's tables, where ``regex`` and the tokenizers library may differ.

    First those that only ``regex`` counts as letters or numbers, then the lower
    case of those that the library lowers.  Each is shown to the library once.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    split, lower = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
    named = regex.compile(r"[\p{L}\p{N}]").match
    young = [c for k in range(0x80, 0x110000) if not 0xD800 <= k < 0xE000 and unicodedata.category(c := chr(k)) == "Cn" and named(c)]
    return frozenset(c for c in young if len(split("!" + c)) == 1), {ord(c): low for c in young if (low := lower(c)) != c}


class ForcedBoundaryBPE:
    """Encoder and decoder of a word-end BPE vocabulary file."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self._entries = entries
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        to_byte = byte_alphabet()
        self.token_of: dict[int, str] = {i: t for t, i in vocab.items()}
        self.added: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token_of |= {i: t for t, i in self.added.items()}
        pairs = next(
            p["pattern"]["Regex"]
            for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split"
        )
        self._words = regex.compile(pairs).findall
        self._unsure, self._young_case = young_characters(path)
        self._has_young_case = regex.compile("[" + "".join(map(chr, self._young_case)) + "]" if self._young_case else r"(?!)").search
        self._other = "\u2603"  # stands for a character that is neither letter nor number
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        shown = {b: c for c, b in to_byte.items()}
        self._inner = [vocab[shown[b]] for b in range(256)]
        self._last = [vocab[shown[b] + END_OF_WORD] for b in range(256)]
        self._rank: dict[int, int] = {}
        self._made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._rank[vocab[a] << 17 | vocab[b]] = rank
            self._made.append(vocab[a + b])
        self._none = len(self._made)
        inside = np.zeros((256, 256), dtype=bool)
        for token in vocab:
            body = bytes(to_byte[c] for c in token.removesuffix(END_OF_WORD) if c in to_byte)
            for x, y in zip(body, body[1:]):
                inside[x, y] = True
        #: certain[x] holds the bytes y for which a cut between x and y is certain.
        self.certain = [frozenset(np.flatnonzero(~inside[x]).tolist()) for x in range(256)]
        self._inner_array, self._last_array = np.array(self._inner, np.int32), np.array(self._last, np.int32)
        self._made_array, self._certain_array = np.array(self._made, np.int32), ~inside
        self._table_key = np.full(1 << _TABLE_BITS, -1, np.int64)
        self._table_rank = np.zeros(1 << _TABLE_BITS, np.int32)
        for key, rank in self._rank.items():
            at = (key * int(_MULTIPLIER) & (1 << 64) - 1) >> (64 - _TABLE_BITS)
            while self._table_key[at] >= 0:
                at = (at + 1) & int(_TABLE_MASK)
            self._table_key[at], self._table_rank[at] = key, rank
        self._fragments: dict[bytes, bytes] = {}
        self._ends: dict[bytes, bytes] = {}
        #: Memos of whole words and of chunks.
        self._whole: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @staticmethod
    def _check(spec: dict) -> None:
        """Refuses files whose steps differ from those built here."""
        steps = spec["normalizer"] or {}
        kinds = [n.get("type") for n in steps.get("normalizers", [steps])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"normalizers {kinds} are not supported")
        if any(not a["content"].startswith("<|") for a in spec["added_tokens"]):
            raise ValueError("added tokens are expected to start with <|")
        if spec["model"]["type"] != "BPE" or spec["model"].get("end_of_word_suffix") != END_OF_WORD:
            raise ValueError("a BPE model with word ends is expected")

    # -- encoding -----------------------------------------------------------
    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut at every certain boundary."""
        certain = self.certain
        cuts = [k for k, (x, y) in enumerate(zip(word, word[1:]), 1) if y in certain[x]]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def _merge(self, ids: list[int]) -> list[int]:
        """The merge procedure over one short fragment."""
        rank, made, none = self._rank.get, self._made, self._none
        ranks = [rank(x << 17 | y, none) for x, y in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != none:
            k = ranks.index(low)
            ids[k] = new = made[low]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank(new << 17 | ids[k + 1], none)
            if k:
                ranks[k - 1] = rank(ids[k - 1] << 17 | new, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for any length."""
        rank, made, n = self._rank, self._made, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank.get(ids[k] << 17 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or rank.get(ids[k] << 17 | ids[j]) != r:
                continue
            ids[k], ids[j] = made[r], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (s := rank.get(ids[k] << 17 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (s, k))
            if before[k] >= 0 and (s := rank.get(ids[before[k]] << 17 | ids[k])) is not None:
                heapq.heappush(heap, (s, before[k]))
        return [x for x in ids if x >= 0]

    def _fragment(self, fragment: bytes, final: bool) -> bytes:
        """Packed ids; the memos hold bytes only, which the garbage collector need not visit."""
        memo = self._ends if final else self._fragments
        if (packed := memo.get(fragment)) is not None:
            return packed
        inner = self._inner
        ids = [inner[b] for b in fragment]
        if final:
            ids[-1] = self._last[fragment[-1]]
        packed = array("I", (self._merge if len(ids) <= SHORT else self._merge_long)(ids)).tobytes()
        if len(fragment) <= CACHE_CHARS:
            if len(memo) >= self._entries:
                memo.clear()
            memo[fragment] = packed
        return packed

    def _word(self, word: bytes) -> bytes:
        if (packed := self._ends.get(word)) is not None:  # an uncut word, or the same bytes as a last fragment
            return packed
        *heads, end = self.fragments(word)
        return b"".join([*(self._fragment(f, False) for f in heads), self._fragment(end, True)])

    def _split(self, chunk: str) -> list[str]:
        """Words of a run without white space."""
        if self._unsure and not chunk.isascii() and not self._unsure.isdisjoint(chunk):
            out, at, other = [], 0, self._other
            text = "".join(other if c in self._unsure else c for c in chunk)
            for word in self._words(text):
                out.append(chunk[at : at + len(word)])
                at += len(word)
            return out
        return self._words(chunk)

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a run without white space, remembered in two generations."""
        packed = self._older.get(chunk)
        if packed is None:
            if chunk.isascii() and chunk.isalpha():
                packed = self._word(chunk.encode())
            elif chunk[-1] in ".,;:!?" and (head := chunk[:-1]).isascii() and head.isalpha():
                packed = (self._chunks.get(head) or self._chunk(head)) + self._chunk(chunk[-1])
            else:
                packed = b"".join([self._word(word.encode()) for word in self._split(chunk)])
            if len(chunk) > CACHE_CHARS:
                return packed
        if len(self._chunks) >= self._entries:
            self._older, self._chunks = self._chunks, {}
        self._chunks[chunk] = packed
        return packed

    def _normal(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if not latin(text) and self._has_young_case(text):  # young characters lie far above
                text = text.translate(self._young_case)
            text = text.replace("Σ", "σ")  # lower() alone would choose the form by context
        return text.lower()

    def _plain(self, text: str) -> bytes:
        text = self._normal(text)
        chunks = [c for c in _SPACE.split(text) if c] if separated(text) else text.split()
        out = list(map(self._chunks.get, chunks))
        if None in out:
            new = self._chunk
            out = [p or new(c) for p, c in zip(out, chunks)]
        return b"".join(out)

    # -- many texts at once -------------------------------------------------
    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, or ``_none``: an open hash table in arrays."""
        key = left.astype(np.int64) << 17 | right
        at = (key * _MULTIPLIER).view(np.uint64) >> np.uint64(64 - _TABLE_BITS)
        out = np.full(len(key), self._none, np.int32)
        rows = np.arange(len(key))
        while len(rows):
            found = self._table_key[at]
            hit = found == key
            out[rows[hit]] = self._table_rank[at[hit]]
            go = ~hit & (found >= 0)
            rows, key, at = rows[go], key[go], (at[go] + np.uint64(1)) & _TABLE_MASK
        return out

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many short words: all fragments take their merges side by side."""
        blob = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        sym = self._inner_array[blob]
        sym[end - 1] = self._last_array[blob[end - 1]]
        first = np.zeros(len(blob), bool)
        first[1:] = self._certain_array[blob[:-1], blob[1:]]
        first[end[:-1]] = True
        first[0] = True
        slot = np.arange(len(blob))
        done = np.full(len(blob), -1, np.int32)
        rank = np.append(self._ranks(sym[:-1], sym[1:]), np.int32(self._none))
        rank[:-1][first[1:]] = self._none
        while len(sym):
            start = np.flatnonzero(first)
            length = np.diff(np.append(start, len(sym)))
            low = np.minimum.reduceat(rank, start)
            place = np.flatnonzero((rank == np.repeat(low, length)) & (rank != self._none))
            fragment = np.searchsorted(start, place, side="right")
            place = place[np.append(True, fragment[1:] != fragment[:-1])] if len(place) else place  # the leftmost
            over = np.repeat(low == self._none, length)
            done[slot[over]] = sym[over]
            sym[place] = self._made_array[rank[place]]
            keep = ~over
            keep[place + 1] = False
            now = np.cumsum(keep)[place] - 1
            sym, first, slot, rank = sym[keep], first[keep], slot[keep], rank[keep]
            n = len(sym)
            for k in (now, now - 1):  # ranks of the pairs on either side of what was merged
                k = k[k >= 0]
                inside = k + 1 < n
                inside[inside] = ~first[k[inside] + 1]
                rank[k] = self._none
                k = k[inside]
                rank[k] = self._ranks(sym[k], sym[k + 1])
        valid = done >= 0
        stop = (4 * np.cumsum(valid)[end - 1]).tolist()
        packed = done[valid].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *stop], stop)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Packed ids of chunks not in the memo; their new words are merged side by side."""
        new: dict[str, bytes] = {}
        plain: list[str] = []
        tails: list[str] = []
        mixed: list[str] = []
        older, known = self._older.get, self._whole.get
        for c in chunks:
            if (packed := older(c)) is not None:
                new[c] = packed
            elif not c:  # before or after the outer blanks of a text
                new[c] = b""
            elif c.isalpha() and len(c) <= CACHE_CHARS:
                plain.append(c)
            elif c[-1] in ".,;:!?" and c[:-1].isalpha() and len(c) <= CACHE_CHARS:
                tails.append(c)
            elif len(c) <= CACHE_CHARS:
                mixed.append(c)
            else:
                new[c] = self._chunk(c)
        heads = [c[:-1] for c in tails]
        split = list(map(self._split, mixed))
        asked = [*plain, *heads, *(w for part in split for w in part), *({c[-1] for c in tails})]
        if len(self._whole) + len(asked) > self._entries:
            self._whole.clear()
        words = dict.fromkeys([w for w in asked if known(w) is None])
        if words:
            self._whole.update(zip(words, self._merge_all([w.encode() for w in words])))
        whole = self._whole
        new.update(zip(plain, map(whole.__getitem__, plain)))
        new.update(zip(tails, [whole[h] + whole[c[-1]] for h, c in zip(heads, tails)]))
        new.update(zip(mixed, [b"".join([whole[w] for w in part]) for part in split]))
        if len(self._chunks) + len(new) > self._entries:
            self._older, self._chunks = self._chunks, {}
        self._chunks.update((c, p) for c, p in new.items() if len(c) <= CACHE_CHARS)
        return new

    def encode_array(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; new words of all texts are merged together."""
        ids: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        todo: list[int] = []
        chars = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text or separated(text):
                ids.append(self._many(texts, todo, counts))
                ids.append(np.frombuffer(self.encode_packed(text), "<u4"))
                counts[k] = len(ids[-1])
                todo, chars = [], 0
                continue
            todo.append(k)
            chars += len(text)
            if chars > MANY_CHARS:
                ids.append(self._many(texts, todo, counts))
                todo, chars = [], 0
        ids.append(self._many(texts, todo, counts))
        return np.concatenate(ids), counts

    def _many(self, texts: list[str | None], todo: list[int], counts: np.ndarray) -> np.ndarray:
        """Every different chunk is looked up once; ids are then gathered by number."""
        if not todo:
            return np.zeros(0, "<u4")
        chunks = pc.utf8_split_whitespace(pa.array([self._normal(texts[k]) for k in todo], pa.large_string()))
        coded = chunks.values.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = list(map(self._chunks.get, different))
        if None in packed:
            new = self._learn([c for c, p in zip(different, packed) if p is None])
            packed = [new[c] if p is None else p for c, p in zip(different, packed)]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        length = size[which]
        after = np.append(0, np.cumsum(length))
        place = np.repeat((start[which] - after[:-1]).astype(np.int32), length) + np.arange(after[-1], dtype=np.int32)
        counts[todo] = np.diff(after[chunks.offsets.to_numpy()])
        return np.frombuffer(b"".join(packed), "<u4")[place]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of every text."""
        ids, counts = self.encode_array(texts)
        packed, ends = ids.tobytes(), np.cumsum(4 * counts).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" not in text or not self._added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._added.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    # -- decoding -----------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: the file names no decoder of its own."""
        return " ".join(map(self.token_of.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, entries: int = CACHE_ENTRIES) -> ForcedBoundaryBPE:
    """One encoder a worker process, vocabulary file and size of its memos."""
    return ForcedBoundaryBPE(path, entries)


Batches = Iterator[pa.RecordBatch]


def _replace(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, name])


#: Bytes of text that are turned into ids and back at a time.
PIECE_BYTES = 6_000_000


def pieces(batches: Batches, text: str = "text", most: int = PIECE_BYTES) -> Batches:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def encode_batches(batches: Batches, path: str, text: str = "text", ids: str = "ids", entries: int = CACHE_ENTRIES, most: int = PIECE_BYTES) -> Batches:
    """Adds the ids of every row's text as a list of integers."""
    bpe = encoder(path, entries)
    for batch in pieces(batches, text, most):
        found, counts = bpe.encode_array(batch.column(text).to_pylist())
        ends = np.append(0, np.cumsum(counts))
        values = pa.array(found.view("<i4"))
        yield _replace(batch, ids, pa.LargeListArray.from_arrays(pa.array(ends), values).cast(pa.list_(pa.int32())))


def decode_batches(batches: Batches, path: str, ids: str = "ids", decoded: str = "decoded", entries: int = CACHE_ENTRIES) -> Batches:
    """Adds the decoded text of every row's ids; null ids decode like none."""
    bpe = encoder(path, entries)
    for batch in batches:
        col = batch.column(ids)
        out = [bpe.decode(v.values.to_pylist()) if v.is_valid else "" for v in col]
        yield _replace(batch, decoded, pa.array(out, type=pa.string()))


def digest_batches(batches: Batches) -> Batches:
    """The digest columns of the contract from ids and decoded text."""
    for batch in batches:
        ids = [v.values.to_numpy().astype("<u4") for v in batch.column("ids")]
        text = [v.as_py().encode() for v in batch.column("decoded")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(v) for v in ids], type=pa.int64()),
                pa.array([hashlib.sha256(v.tobytes()).hexdigest() for v in ids]),
                pa.array([hashlib.sha256(v).hexdigest() for v in text]),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode_documents(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an array<int> column of token ids."""
    return df.mapInArrow(lambda it: encode_batches(it, path, text, ids), _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode_documents(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with a string column of decoded text."""
    return df.mapInArrow(lambda it: decode_batches(it, path, ids, decoded), _schema(df, decoded, T.StringType()))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary lies (the default of the queries)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes and decodes every document; the three steps share one Python pass."""
    path = path or vocabulary_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(
        lambda it: digest_batches(decode_batches(encode_batches(it, path), path)),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: every row with its ids, their number and the decoded text."""
    path = vocabulary_path()
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in ("ids", "decoded")), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    small = {"entries": 100_000}  # earlier stages' memory is still held by the executors
    out = docs.mapInArrow(lambda it: decode_batches(encode_batches(it, path, most=2_000_000, **small), path, **small), schema)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))
