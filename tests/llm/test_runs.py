"""Periodic runs: against brute force over all periods, the query against a plain computation, odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import runs as m


def plain_runs(words, least=24, exponent=3):
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def searched(texts, **kw):
    return [list(map(tuple, r.tolist())) for _, r in m.search([t.encode() for t in texts], **kw)]


PIECES = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 9)), max_size=8)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(PIECES, max_size=4), kind=st.sampled_from([(24, 3), (2, 2), (4, 2), (6, 3), (5, 4)]))
def test_all_runs_are_found(texts, kind):
    words = [[w for part, k in t for w in part * k] for t in texts]
    assert searched([" ".join(w) for w in words], least=kind[0], exponent=kind[1]) == [plain_runs(w, *kind) for w in words]


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabets(seed):
    rng = np.random.default_rng(seed)
    texts = [[str(c) for c in rng.integers(0, 2 + seed % 2, 150)] for _ in range(3)]
    for kind in ((2, 2), (6, 2), (6, 3)):
        assert searched([" ".join(t) for t in texts], least=kind[0], exponent=kind[1]) == [plain_runs(t, *kind) for t in texts]


def test_fibonacci_words_and_powers():
    a, b = "a", "a b"
    for _ in range(9):
        a, b = b, b + " " + a
    nested = ("x " * 30 + "y ") * 8 + "x " * 400
    for text in (b, nested, "a " * 23, "a " * 24, "a b c d e f g h " * 3, "a b c d e f g h i " * 3, "a b c d e f g h i " * 2 + "a b c d e f g h"):
        assert searched([text]) == [plain_runs(text.split())]


def test_suffix_array():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 50, 300):
        s = rng.integers(0, 3, n)
        order, inverse, common = m.enhanced_suffix_array(s)
        t = s.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:])
        assert inverse[order].tolist() == list(range(n))
        want = [next((k for k in range(n) if max(a, b) + k >= n or t[a + k] != t[b + k]), n) for a, b in zip(order, order[1:])]
        assert common.tolist() == [-1, *want, -1]


def test_runs_do_not_cross_texts_or_blanks():
    assert searched(["a b " * 11, "a b " * 11, "\t".join(["a\nb"] * 12), "a b " * 30, ""]) == [[], [], [(0, 24, 2)], [(0, 30, 1)], []]


def test_long_texts():
    words = [f"w{k}" for k in range(60_000)]
    text = words + words[-10_000:] * 4 + ["z"] * 300_000 + ["end"]
    runs = searched([" ".join(text)])[0]
    assert runs == [(50_000, 50_000, 10_000), (100_000, 300_000, 1)]


def plain_query(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = fast_plain(words)
    best = max(runs, key=lambda r: r[1] / r[2], default=None)
    for r in runs:
        best = r if r[1] * best[2] > best[1] * r[2] else best
    first = next((r for r in runs if r[1] * best[2] == best[1] * r[2]), None) if best else None
    tail = (*first, 1000 * first[1] // first[2]) if first else (None,) * 4
    return (doc_id, len(runs), *tail, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest())


def fast_plain(words, least=24, exponent=3):
    """Brute force over all periods in arrays: the same as ``plain_runs``."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x, found = np.array([ids[w] for w in words], int), []
    for q in range(1, len(x) // exponent + 1):
        same = np.append(np.append(False, x[:-q] == x[q:]), False)
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = j - i + q
            if length >= max(least, exponent * q) and not any((x[i : i + length - p] == x[i + p : i + length]).all() for p in range(1, q)):
                found.append((i, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_query(spark, sf_dir):
    want = sorted(plain_query(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted(map(tuple, m.op12_runs(spark, sf_dir).collect()))
    assert got == want and sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 40), (4, "a b " * 20), (4, "a b " * 20), (None, None), (5, "é ü " * 30)]
    rows += [(i, "x y z " * 50 if i % 2 else "q " * (i % 30)) for i in range(100, 160)]
    spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, period int").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple("" if c is None else str(c) for c in r)
    got = sorted(map(tuple, m.op12_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((plain_query(i, t) if i is not None else (None, *plain_query(2, t)[1:]) for i, t in rows), key=key)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.periodic_runs(docs, "doc_id").count() == 0


def test_small_slices_give_the_same(spark, monkeypatch):
    texts = ["a b c " * k for k in range(30)] + [None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
    whole = sorted(m.periodic_runs(df, "k").collect())
    monkeypatch.setattr(m, "SLICE_BYTES", 50)
    assert [m.collapse(w, r).decode() for w, r in m.search([(t or "").encode() for t in texts])] == [r.collapsed for r in whole]
    assert sorted(m.periodic_runs(df, "k").collect()) == whole
