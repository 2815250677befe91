"""Periodic runs of words (operator 12).

A run is a stretch of words with smallest period q, at least ``exponent`` periods
and ``least`` words long, that no neighbouring word extends.  Runs are found by the
branching-tandem test over an enhanced suffix array (suffix array, its inverse and
common prefixes of neighbours): for each interval of suffixes with a common prefix
of d words, every suffix i outside the largest child asks whether suffix i + d or
i - d lies in the interval too; if the word after both differs from the one a
period earlier, two copies end there.  Each such square is rotated to the left as
far as the period holds; squares of one end belong to the run of the smallest
period if they fit into it.  Intervals are three arrays (left, right, depth); no tree
is built.

Only stretches that can hold a run get a suffix array.  A run repeats at least
``overlap`` words of itself one period later, so every word of it lies in a window
of that many words that starts twice or more in its text.  Windows are compared by
hashes: chance collisions add words to a stretch and lose none.

Texts are searched in the task that reads them, many at a time; nothing is shuffled
and a lost task is run again.  Memory is that of ``SLICE_BYTES`` of texts, or of one
longer text.

Edge cases: null and empty texts and texts of blanks have no words and no runs;
repeated rows and null ids are kept, each row by itself; columns that aren't asked
for are left out, ``runs`` and ``collapsed`` are reserved; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.quality import words_of
from sparkloom.llm.shared import let
from sparkloom.llm.suffixes import window_hashes

LEAST = 24
EXPONENT = 3
SLICE_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 21


def overlap(least: int, exponent: int) -> int:
    """So many words, or more, of a run occur again one period later, whatever the period."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two words and two periods or more")
    q = least // exponent
    return min(least - q, (exponent - 1) * (q + 1))


def stretches(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words in windows of ``size`` words that start twice in their text, and a number for each stretch of them."""
    n = len(words)
    if n <= size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    keys = window_hashes(words, size)[whole] + text[whole].astype(np.uint64) * _ODD
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    twice = whole[order[np.append(False, same) | np.append(same, False)]] if len(order) else whole
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + size, -1)
    at = np.flatnonzero(np.cumsum(step[:n]))
    cut = (np.diff(at, prepend=-2) != 1) | (np.diff(text[at], prepend=-1) != 0)
    return at, np.cumsum(cut) - 1


def enhanced_suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the common prefix of each suffix with the one before it (first and last: -1).

    Prefix doubling: ranks by 1, 2, 4, ... symbols; only suffixes that are not yet
    told apart are sorted again.  Common prefixes are read off the ranks, longest first.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, width = [rank.astype(np.int32)], 1
    while True:
        # places in ``order`` of groups of two or more
        alone = first & np.append(first[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        i = order[places]
        after = np.where(i + width < n, rank[np.minimum(i + width, n - 1)] + 1, 0)
        key = rank[i] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        i, key = i[by], key[by]
        order[places] = i
        first[places] = np.append(True, key[1:] != key[:-1])
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        width *= 2
        levels.append(rank.astype(np.int32))
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        inside = inside[levels[level][a[inside]] == levels[level][b[inside]]]
        for x in (a, b, common):
            x[inside] += 1 << level
    return order, rank, np.concatenate([[-1], common, [-1]])


def intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every boundary of suffixes: left and right end of its interval, and the interval's first boundary."""
    n = len(common) - 1
    h, left, right, head, stack = common.tolist(), [0] * (n + 1), [n] * (n + 1), list(range(n + 1)), [0]
    for k in range(1, n + 1):
        now = h[k]
        while h[stack[-1]] > now:
            right[stack.pop()] = k
        top = stack[-1]
        if h[top] == now:
            left[k], head[k] = left[top], head[top]
        else:
            left[k] = top
        stack.append(k)
    return np.array(left), np.array(right) - 1, np.array(head)


def branching_squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End (place after) and period of all squares whose period the next word breaks."""
    n = len(symbols)
    order, inverse, common = enhanced_suffix_array(symbols)
    left, right, head = intervals(common)
    k = np.flatnonzero(common[:n] > 0)
    if not len(k):
        return k, k
    k = k[np.argsort(head[k], kind="stable")]
    group = head[k]
    opens = np.append(True, group[1:] != group[:-1])
    closes = np.append(opens[1:], True)
    # children: one before the first boundary of each interval, one after every boundary
    begin = np.concatenate([left[k[opens]], k])
    stop = np.concatenate([k[opens], np.where(closes, right[k] + 1, np.append(k[1:], 0))])
    owner = np.concatenate([k[opens], k])
    size = stop - begin
    by = np.lexsort((size, head[owner]))
    begin, size, owner = begin[by], size[by], owner[by]
    small = head[owner[:-1]] == head[owner[1:]]  # all but the largest, which is last
    begin, size, owner = begin[:-1][small], size[:-1][small], owner[:-1][small]
    ends, periods = [], []
    total = np.cumsum(size)
    pieces = np.searchsorted(total, np.arange(0, total[-1], _CELLS))
    for a, b in zip(pieces, np.append(pieces[1:], len(size))):  # so many suffixes at a time
        s = size[a:b]
        at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(begin[a:b], s)
        own = np.repeat(owner[a:b], s)
        i, d, lo, hi = order[at], common[own], left[own], right[own]
        for start, other in ((i, i + d), (i - d, i - d)):
            good = (other >= 0) & (other < n)
            place = inverse[np.where(good, other, 0)]
            good &= (place >= lo) & (place <= hi)
            x, p = start[good], d[good]
            end = x + 2 * p
            good = (end >= n) | (symbols[np.minimum(end, n - 1)] != symbols[end - p])
            ends.append(end[good])
            periods.append(p[good])
    found = np.unique(np.stack([np.concatenate(ends), np.concatenate(periods)]), axis=1)
    return found[0], found[1]


def rotations(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each square can be moved to the left."""
    moved, active, width = np.zeros(len(start), np.int64), np.arange(len(start)), 16
    while len(active):
        rest = []
        for part in np.array_split(active, max(1, len(active) * width // _CELLS)):
            i = (start[part] - moved[part])[:, None] - np.arange(1, width + 1)
            same = (i >= 0) & (symbols[np.maximum(i, 0)] == symbols[np.maximum(i, 0) + period[part][:, None]])
            steps = np.where(same.all(axis=1), width, same.argmin(axis=1))
            moved[part] += steps
            rest.append(part[steps == width])
        active, width = np.concatenate(rest), min(2 * width, _CELLS)
    return moved


def runs_of(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs; symbols of different stretches must differ."""
    end, period = branching_squares(symbols)  # sorted by end, then period
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(end):
        first = np.append(True, end[1:] != end[:-1])
        e, q = end[first], period[first]
        length = 2 * q + rotations(symbols, e - 2 * q, q)
        long = length >= np.maximum(least, exponent * q)
        kept.append((e[long] - length[long], length[long], q[long]))
        # other squares of that end that fit into the run are powers of it
        left = 2 * period > length[np.cumsum(first) - 1]
        end, period = end[left], period[left]
    if not kept:
        return end, end, end
    start, length, period = (np.concatenate(x) for x in zip(*kept))
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def search(texts: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[list[bytes], np.ndarray]]:
    """Words and runs (rows of start, length, period by start, then period) of every text."""
    words = [t.split() for t in texts]  # of bytes: at space and tab to carriage return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    ids = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    numbers = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
    text = np.repeat(np.arange(len(texts)), sizes)
    at, stretch = stretches(numbers, text, overlap(least, exponent))
    if not len(at):
        return [(ws, np.zeros((0, 3), np.int64)) for ws in words]
    _, symbols = np.unique(stretch * len(ids) + numbers[at], return_inverse=True)
    start, length, period = runs_of(symbols, least, exponent)
    owner = text[at[start]]
    rows = np.stack([at[start] - (np.cumsum(sizes) - sizes)[owner], length, period], axis=1)
    rows = rows[np.argsort(owner, kind="stable")]
    return list(zip(words, np.split(rows, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])))


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside all runs and those of each run's first period (unless another run drops them)."""
    if len(runs):
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, *keep: str, text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The kept columns, ``runs`` (array of start, length, period in words) and ``collapsed`` (the text without repeats) of every row."""
    names = [*keep, "runs", "collapsed"]
    overlap(least, exponent)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0))
            cuts = [0]
            while cuts[-1] < len(texts):
                done = sizes[cuts[-1] - 1] if cuts[-1] else 0
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, side="right"))))
            for a, b in zip(cuts, cuts[1:]):
                found = search(texts.slice(a, b - a).to_pylist(), least, exponent)
                rows = np.concatenate([r for _, r in found])
                offsets = np.append(0, np.cumsum([len(r) for _, r in found])).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], fields=list(kind)))
                collapsed = pa.array([collapse(w, r) for w, r in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(a, b - a) for k in range(len(keep))), runs, collapsed], names)

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keep) + "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"), *keep).mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth id (by checksum) with its words from a place on repeated with a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words_of(text), repeated)).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with repeats planted into every tenth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")), "doc_id")
    # runs are sorted by start, then period: only a greater exponent takes the first one's place
    greater = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), greater)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
