"""Re-Pair shards: exact round trips, random access and places."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe
from sparkloom.llm import token_files as m


def frequent_pairs(symbols, ends_after):
    """Occurrences of every pair inside documents that don't overlap, by plain counting."""
    count, k, before = {}, 0, None
    for k in range(len(symbols) - 1):
        pair = (symbols[k], symbols[k + 1])
        if ends_after[k] or (pair == before and pair[0] == pair[1]):
            before = None  # the second of two overlapping twins
            continue
        count[pair] = count.get(pair, 0) + 1
        before = pair
    return count


def shard_of(docs):
    packed = [np.array([*d, m.END_ID], np.uint32) for d in docs]
    return m.Shard(m._record(0, 0, list(range(len(docs))), [len(p) for p in packed], packed)), packed


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=8), st.integers(1, 30), st.booleans())
def test_round_trip(docs, times, hashed):
    few, m._FEW = m._FEW, 0 if hashed else m._FEW
    try:
        shard, packed = shard_of([d * times for d in docs])
    finally:
        m._FEW = few
    whole = np.concatenate(packed)
    assert (shard.expand(shard.symbols) == whole).all()
    for k, p in enumerate(packed):
        assert (shard.document(k) == p).all()
    for a, b in ((0, 1), (len(whole) // 3, len(whole) // 2), (len(whole) - 1, len(whole)), (2, 2)):
        assert (shard.span(a, b) == whole[a:b]).all()
    assert all(len(shard.expand(np.array([shard.base + k]))) == n for k, n in enumerate(shard.lengths))
    # Re-Pair went on until no pair is frequent, across rules and rounds
    ends = np.cumsum(shard.sizes(shard.symbols))
    last = np.isin(ends, np.cumsum([len(p) for p in packed]))
    assert max(frequent_pairs(shard.symbols.tolist(), last.tolist()).values(), default=0) < m.LEAST


def test_hashed_and_exact_counts_shrink_texts_alike(monkeypatch):
    ids = np.random.default_rng(3).zipf(1.3, 60_000).clip(0, 3000).astype(np.uint32)
    sizes = []
    for few, bits in ((0, 18), (0, 6), (1 << 30, 18)):
        monkeypatch.setattr(m, "_FEW", few)
        monkeypatch.setattr(m, "_HASH_BITS", bits)
        base, table, symbols = m.compress(ids, np.array([30_000, 60_000]))
        sizes.append(len(symbols) + 3 * len(table))
        ends = np.zeros(len(symbols), bool)
        assert max(frequent_pairs(symbols.tolist(), ends.tolist()).values()) <= m.LEAST + 1  # the documents' ends apart
    assert max(sizes) < 1.05 * min(sizes)


def test_pairs_shrink_a_shard():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    _, table, symbols = m.compress(ids, np.array([10_000, 20_000]))
    assert len(symbols) + len(table) < 150
    one = np.zeros(1 << 12, np.uint32)
    _, table, symbols = m.compress(one, np.array([1 << 12]))
    assert len(table) == 10 and len(symbols) < m.LEAST * 2


def expected(rows):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, m.op4_token_files(spark, sf_dir).collect())) == expected(rows)


def test_edges(spark):
    rows = [(3, None, 1), (2, "", 1), (2, "b b b", 2), (None, "x", 2), (9, "the " * 9000, 3), (1, '" " "', 4), (2, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = sorted(map(tuple, m.read_shards(m.stage(m.write_shards(df), "t")).collect()), key=lambda r: r[1])
    assert got == expected([r[:2] for r in rows])
    assert m.read_shards(m.stage(m.write_shards(df.limit(0)), "t")).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", None), (None, "z")], "doc_id string, text string")
    got = sorted(map(tuple, m.read_shards(m.stage(m.write_shards(df), "t")).collect()), key=lambda r: r[1])
    assert got == expected([("b", "x y"), ("a", None), (None, "z")])
