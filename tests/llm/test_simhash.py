"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from sparkloom.llm import components as c
from sparkloom.llm import simhash as m

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_print(text):
    text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    w = WORD.findall(text)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fp = np.array([prints[i] for i in ids], dtype=np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[k] ^ fp[k + 1 :]) <= 4):
            a, b = find(ids[k]), find(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    rnd = random.Random(3)
    words = ["The", "É", "x", "and", "Zoë", "of", "数"]
    for n in [0, 1, 3, 4, 5, 200]:
        text = "".join(rnd.choice(words) + rnd.choice(" \t\n\x0b") for _ in range(n))
        assert m.fingerprint(text) == brute_print(text)
    assert m.fingerprint(None) == m.fingerprint(" \n") == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute_components({d.doc_id: brute_print(d.text) for d in docs})
    got = m.op10_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(docs)
    assert all(r.fingerprint == f"{brute_print(d.text):016x}" for d in docs for r in got if r.doc_id == d.doc_id)


def planted(seed, n, hot):
    """Fingerprints by id: random ones with near copies, a share ``hot`` of them about one centre."""
    rnd = random.Random(seed)
    prints = {}
    for _ in range(n):
        base = 0x123456789ABCDEF0 if rnd.random() < hot else rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 4])):
            fp = base
            for _ in range(rnd.randint(0, 5)):
                fp ^= 1 << rnd.randint(0, 63)
            prints[len(prints)] = fp
    return prints


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_links_in_tiles(spark, monkeypatch):
    prints = planted(5, 600, 0.5)
    want = brute_components(prints)
    df = spark.createDataFrame([(i, signed(x)) for i, x in prints.items()], "id long, fp long")
    for rows, group in ((4096, 50_000), (64, 50_000), (64, 300)):
        monkeypatch.setattr(m, "SHARD_ROWS", rows)
        monkeypatch.setattr(m, "GROUP_ROWS", group)
        got = {r.fp: r.component_id for r in m.named(df).collect()}
        assert {i: got[signed(x)] for i, x in prints.items()} == want


def test_no_link_is_missed_and_few_pairs_are_compared(spark):
    """Every pair of linked fingerprints shares a shard where one is at home; compared pairs are far fewer than all."""
    shares = []
    for n in (1000, 2000, 4000):
        prints = sorted({signed(x) for x in planted(n, n, 0.0).values()})
        rows = m.visits(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()
        home, all_ = {}, {}
        for r in rows:
            all_.setdefault(r.shard, set()).add(r.fp)
            if r.home:
                home.setdefault(r.shard, set()).add(r.fp)
        met = {(min(a, b), max(a, b)) for s, h in home.items() for a in h for b in all_[s] if a != b}
        fp = np.array(prints, dtype=np.int64).view(np.uint64)
        near = {(prints[i], prints[j]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 4) if prints[i] < prints[j]}
        assert near <= met and near
        shares.append((len(met) - len(near)) / len(prints))
    assert max(shares) < 2  # pairs compared in vain a fingerprint, of up to 8,000 others


def test_radius_beyond_the_trees_is_refused(spark):
    with pytest.raises(ValueError):
        m.links(spark.range(1).selectExpr("id fp"), 1, 6)


def test_stage_keeps_one_row_a_component(spark):
    rows = [(1, "one two", 1), (5, "one two", 2), (5, "nobody else says this here", 3), (None, "one  two", 4), (7, "q", 5), (7, "q", 5), (None, "lost and found", 6), (None, "lost and found", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __maybe int").repartition(3)
    out = m.one_of_each(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "one two"), (5, rows[2][1]), (7, "q"), (None, "lost and found")], key=str)
    assert m.one_of_each(spark, df.limit(0), "").count() == 0


def test_edges(spark):
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (2, "", 2, "b"), (None, " \t", 3, None), (3, "one two", 4, "x"), (4, "ONE\ntwo", 4, "x"), (None, "alone here", 5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, id string")
    got = sorted(((r.doc_id, r.component_id) for r in m.near_components(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (None, 1), (3, 3), (4, 3), (None, None)], key=str)
    assert m.near_components(df.limit(0)).count() == 0


def test_long_chains(spark):
    links = spark.range(300).selectExpr("id * 7 % 301 a", "(id + 1) * 7 % 301 b")
    assert {r.component for r in c.components(links).collect()} == {0}
