"""Two-stage suffix sorting of many short strings, in arrays (used by operator 3).

A suffix is of type B if it is smaller than its successor (the suffix one byte
later), else of type A.  Type B suffixes are sorted directly, by their first
``length`` bytes.  Type A suffixes are induced: buckets of first bytes are scanned
in ascending order, and a sorted suffix puts its predecessor, if of type A, at the
next free place of the predecessor's bucket.  Only suffixes that start a window of
``length`` bytes, and those they are induced from, are sorted.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window of ``length`` bytes."""
    n = len(data)
    # in place where it can be: each array is eight times as large as the text
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n - 1, 0), _ODD)))[:n]
    terms, total = data.astype(np.uint64), np.zeros(n + 1, np.uint64)
    terms += np.uint64(1)
    terms *= power
    np.cumsum(terms, out=total[1:])
    del power, terms
    out = total[length:] - total[: n - length + 1]
    del total
    out *= np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n - length, 0), _INVERSE)))[: n - length + 1]
    return out


def suffix_order(data: np.ndarray, ends: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Window starts of all strings in suffix order.

    data: the strings, one after another; ends: the place after each; windows: how many windows each has.
    """
    n = len(data)
    starts = np.append(0, ends[:-1])
    # types: compare with the next different byte; a string's last byte is greater than the empty suffix
    greater = np.zeros(n, bool)
    greater[:-1] = data[:-1] > data[1:]
    same = np.zeros(n, bool)
    same[:-1] = data[:-1] == data[1:]
    greater[ends - 1], same[ends - 1] = True, False
    decided = np.where(same, np.int32(n - 1), np.arange(n, dtype=np.int32))
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    type_a = greater[decided]
    del decided, greater, same
    # the suffixes to sort: every window start, and on to the first of type B
    next_b = np.minimum.accumulate(np.where(type_a, np.int32(n), np.arange(n, dtype=np.int32))[::-1])[::-1]
    stop = np.minimum(next_b[starts + windows - 1].astype(np.int64) + 1, ends)
    del next_b
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, stop, -1)
    inside = np.cumsum(inside[:n]) > 0
    # first stage: type B directly, those of one first pair of bytes at a time: only their keys are held
    b = np.flatnonzero(inside & ~type_a)
    raw = data.tobytes()
    limit = np.minimum(b + length, ends[np.searchsorted(ends, b, side="right")])
    pair = data[b].astype(np.int32) << 9  # a suffix of one byte comes before all that go on
    longer = limit - b > 1
    pair[longer] |= data[b[longer] + 1].astype(np.int32) + 1
    order = np.argsort(pair, kind="stable")
    b, limit, pair = b[order], limit[order], pair[order]
    edges = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])).tolist() if len(b) else []
    del order, pair, longer
    for i, j in zip(edges, [*edges[1:], len(b)]):
        keys = [raw[x:y] for x, y in zip(b[i:j].tolist(), limit[i:j].tolist())]
        b[i:j] = b[i:j][sorted(range(len(keys)), key=keys.__getitem__)]
    del raw, limit
    cut = np.searchsorted(data[b], np.arange(257))
    # second stage: type A by scans of the buckets
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    takes = np.zeros(n, bool)  # suffixes whose predecessor is to be induced
    takes[1:] = (inside & type_a)[:-1]
    takes &= ~is_start
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = ends[inside[ends - 1]] - 1
    for c in np.unique(data[last]).tolist():
        pending[c].append(last[data[last] == c])
    order: list[np.ndarray] = []
    for c in range(256):
        layer = np.concatenate(pending[c]) if pending[c] else b[:0]
        layers = [layer]
        while len(layer):  # runs of one byte: predecessors in the same bucket
            layer = layer[takes[layer]] - 1
            layer = layer[data[layer] == c]
            layers.append(layer)
        now = np.concatenate([*layers, b[cut[c] : cut[c + 1]]])
        if not len(now):
            continue
        order.append(now)
        before = now[takes[now]] - 1
        before = before[data[before] > c]
        first = data[before]
        before = before[np.argsort(first, kind="stable")]
        chars, at = np.unique(data[before], return_index=True)
        for k, part in zip(chars.tolist(), np.split(before, at[1:])):
            pending[k].append(part)
    result = np.concatenate(order) if order else b
    window = np.zeros(n + 1, np.int32)
    np.add.at(window, starts, 1)
    np.add.at(window, starts + windows, -1)
    return result[np.cumsum(window[:n])[result] > 0]


def repeated_windows(strings: list[bytes], twice: np.ndarray, length: int) -> list[np.ndarray]:
    """For every string which of its windows also start elsewhere in these strings.

    twice: strings that stand for several equal ones, whose windows all repeat.
    Adjacent suffixes with a common prefix of ``length`` bytes are repeats.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(size)
    windows = size - length + 1
    order = suffix_order(data, ends, windows, length)
    hashes = window_hashes(data, length)
    a, b = order[:-1], order[1:]
    near = hashes[a] == hashes[b]
    a, b = a[near], b[near]
    good = common_prefix(data, a, b, length)
    found = np.zeros(len(data), bool)
    found[a[good]] = found[b[good]] = True
    starts = ends - size
    return [np.ones(n, bool) if t else found[s : s + n] for s, n, t in zip(starts.tolist(), windows.tolist(), twice.tolist())]


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes a and b share ``length`` bytes, byte for byte.

    Where the pair one byte earlier is in the list too, only the last byte is new.
    """
    order = np.argsort(a)
    x, y = a[order], b[order]
    follows = np.append(False, (np.diff(x) == 1) & (np.diff(y) == 1)) if len(x) else np.zeros(0, bool)
    equal = data[x + length - 1] == data[y + length - 1]
    heads = np.flatnonzero(~follows)
    view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    for k in range(0, len(heads), 20_000):
        h = heads[k : k + 20_000]
        equal[h] = (view[x[h]] == view[y[h]]).all(axis=1)
    # a pair holds if its run's head and every later byte hold
    bad = np.cumsum(~equal)
    run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(x)))) if len(x) else np.zeros(0, np.int64)
    holds = (bad - np.where(run > 0, bad[run - 1], 0) == 0) if len(x) else np.zeros(0, bool)
    out = np.zeros(len(a), bool)
    out[order] = holds
    return out
