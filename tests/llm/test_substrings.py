"""Repeated substrings and suffix order against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import substring_dedup as m
from sparkloom.llm import suffixes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_suffix_order(strings):
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    windows = np.array([len(s) - 3 for s in strings])
    got = suffixes.suffix_order(data, ends, windows, 4)
    which = np.searchsorted(ends, got, side="right")
    grams = [data[i : i + 4].tobytes() for i in got.tolist()]
    assert grams == sorted(grams) and sorted(got.tolist()) == [e - len(s) + k for e, s in zip(ends, strings) for k in range(len(s) - 3)] and len(which) == len(got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_repeated_windows(strings):
    grams = [s[k : k + 4] for s in strings for k in range(len(s) - 3)]
    got = suffixes.repeated_windows(strings, np.zeros(len(strings), bool), 4)
    assert [[bool(x) for x in g] for g in got] == [[grams.count(s[k : k + 4]) > 1 for k in range(len(s) - 3)] for s in strings]


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(raw):
        for k in range(len(b) - m.LENGTH + 1):
            seen.setdefault(b[k : k + m.LENGTH], []).append((d, k))
    gone = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, k in places:
                gone[d][k : k + m.LENGTH] = True
    out = []
    for b, g in zip(raw, gone):
        edges = np.diff(np.concatenate([[0], g.view(np.int8), [0]]))
        out.append((len(b), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    return out


def texts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    p, q = prose(60), prose(90)
    return [
        p, p, prose(80) + p + prose(30), q[:150] + prose(40) + q[100:], q, "x" * 450, "x" * 199, "y" * 200, "y" * 200, None, "",
        prose(30) + q[20:219] + prose(9), prose(30) + q[21:230] + prose(9), "ab" * 300, p[:250] + q[:300] + p[100:],
    ]


@pytest.mark.parametrize("size,many", [(3_000_000, 2_000), (1, 2_000), (1, 1), (1, 3)])
def test_documents(spark, tmp_path, monkeypatch, size, many):
    monkeypatch.setattr(m, "SORT_BYTES", size)
    monkeypatch.setattr(m, "MANY_SEGMENTS", many)
    rows = [(k, t, "x", 5) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, anchor string, key int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, m.op3_substrings(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == [(k, *r) for k, r in enumerate(brute(texts()))]


def test_passage_in_many_contexts(spark, tmp_path, monkeypatch):
    """One passage in 60 contexts: its outer anchors are crowded, and no context may be taken with it."""
    monkeypatch.setattr(m, "MANY_SEGMENTS", 8)
    rnd = random.Random(11)
    noise = lambda: "".join(rnd.choice("abcdefgh") for _ in range(150))
    passage = "".join(rnd.choice("mnopqrst") for _ in range(290))
    texts = [noise() + passage[k % 7 :] + noise() for k in range(60)] + [passage[:150] + noise() for _ in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, m.op3_substrings(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == [(k, *r) for k, r in enumerate(brute(texts))]


def test_long_texts_are_searched_in_parts(monkeypatch):
    monkeypatch.setattr(m, "PART_BYTES", 1000)
    data = np.frombuffer(np.random.default_rng(1).integers(97, 101, 5000, np.uint8).tobytes(), np.uint8)
    anchor, _, start, size = m.segments(data)
    covered = np.concatenate([np.arange(a, a + n - m.LENGTH + 1) for a, n in zip(start, size)])
    assert sorted(covered.tolist()) == list(range(5000 - m.LENGTH + 1)) and len(anchor) == len(start)


def test_repeated_ids_and_no_rows(spark, tmp_path):
    rows = [(1, "z" * 300), (1, "z" * 300), (None, "w" * 10), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in m.op3_substrings(spark, f"{tmp_path}/a").collect())
    assert got == [(False, 300, 300), (False, 300, 300), (True, 0, 0), (True, 10, 0)]
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert m.op3_substrings(spark, f"{tmp_path}/b").count() == 0


def test_query(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    got = sorted(map(tuple, m.op3_substrings(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == [(d.doc_id, *r) for d, r in zip(docs, brute([d.text for d in docs]))]


def test_keys_of_all_suffixes_are_not_held_at_once():
    rnd = np.random.default_rng(3)
    strings = [bytes(rnd.integers(97, 123, 300, np.uint8)) for _ in range(1000)]
    data, ends = np.frombuffer(b"".join(strings), np.uint8), np.arange(300, 300_001, 300)
    tracemalloc.start()
    order = suffixes.suffix_order(data, ends, np.full(1000, 101), 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(order) == 101_000 and peak < 40 * len(data)


def test_only_texts_that_show_the_asked_segments_are_dealt(spark):
    """A cut of few segments (those of crowded anchors) does not move the texts that show others."""
    rnd = random.Random(5)
    docs = spark.createDataFrame([(k, "".join(rnd.choice("abcdefgh") for _ in range(300))) for k in range(50)], "key long, text string")
    shown = spark.createDataFrame([(1, 2, 3, 7, 10, 200)], "anchor long, content long, n long, key long, start int, size short")
    cut = m.cut_segments(docs, shown)
    assert [(r.anchor, r.content, r.n, len(r.bytes)) for r in cut.collect()] == [(1, 2, 3, 200)]
    assert "bitmap_construct_agg" in cut._jdf.queryExecution().optimizedPlan().toString()
    assert cut.columns == ["anchor", "content", "n", "bytes"]


def test_anchors_are_placed_where_segments_are_cut(spark):
    raw = np.random.default_rng(9).integers(97, 105, 700, np.uint8)
    docs = spark.createDataFrame([(0, raw.tobytes().decode())], "key long, text string")
    rows = [(int(a), int(c), 1, 0, int(x), int(n)) for a, c, x, n in zip(*(y.view(np.int64) for y in m.segments(raw)))]
    shown = spark.createDataFrame(rows, "anchor long, content long, n long, key long, start int, size short")
    cut = m.cut_segments(docs, shown, placed=True)
    assert cut._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = cut.collect()
    assert len(got) == len(rows) and all(m.gram_hashes(np.frombuffer(r.bytes, np.uint8))[r["at"]] == np.uint64(r.anchor % 2**64) for r in got)
