"""Quality rules against SQL and plain counting."""

import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same

from sparkloom.llm import quality as m

BLANK = "\x20\x09-\x0d"


def test_query(spark, sf_dir):
    assert_same(m.op6_quality(spark, sf_dir), m.OP6_SQL, sf_dir)


def plain(text):
    text = text or ""
    words = re.findall(f"[^{BLANK}]+", text)
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(f"[^{BLANK}]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x " * 9, "a b c d a b c\n a b c d\na b\na b\n", "é # é # é # ü", "a\x0bb\x0cc\rd a b c", "p q " * 3000, "a\xa0b c\xa0d", "<b>&|</b>\n\n<b>&|</b>"]


def test_counts(spark):
    df = spark.createDataFrame([(k, t, "s", True) for k, t in enumerate(TEXTS)], "doc_id long, text string, source string, kept boolean")
    got = {r.doc_id: tuple(r[c] for c in m.COUNTS) for r in m.judge(df).collect()}
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)}


def test_hosts(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "x"
    rows = [(k, bad if k % 10 else good, "bad") for k in range(1000)] + [(k, good if k % 50 else bad, f"h{k % 8}") for k in range(1000, 3000)] + [(5000, good, None), (5000, good, None)]
    got = m.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {(r.source, r.base_failed, r.kept) for r in got.collect()}
    assert ("bad", False, True) not in kept and ("bad", False, False) in kept
    assert ("h1", False, True) in kept and (None, False, True) in kept and got.count() == len(rows)


def test_chance_is_not_taken_for_a_bad_host(spark):
    """40 hosts that differ by sampling alone: all rates are the mean; one small host is no outlier among large ones."""
    good, bad = " ".join(f"w{k}" for k in range(60)), "x"
    rnd = random.Random(4)
    rows = [(k, bad if rnd.random() < 0.1 else good, f"h{k % 40}") for k in range(4000)]
    judged = m.base_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source")
    rates = [r.rate for r in m.host_rates(judged).collect()]
    by_host = {}
    for _, t, h in rows:
        by_host.setdefault(h, []).append(t == bad)
    n = [len(v) for v in by_host.values()]
    mean = sum(map(sum, by_host.values())) / sum(n)
    square = sum(sum(v) ** 2 / len(v) for v in by_host.values())
    spread = (square - sum(n) * mean**2 - 39 * mean * (1 - mean)) / (sum(n) - sum(x * x for x in n) / sum(n) - 39)
    strength = max(mean * (1 - mean) / spread - 1, 0) if spread > 1e-9 else None
    want = [mean if strength is None else (sum(v) + mean * strength) / (len(v) + strength) for v in by_host.values()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(sorted(rates), sorted(want)))
    tiny = rows + [(9000, bad, "tiny"), (9001, bad, "tiny"), (9002, good, "tiny")] + [(9100 + k, bad if k % 8 else good, "rotten") for k in range(200)]
    got = m.judge(spark.createDataFrame(tiny, "doc_id long, text string, source string")).collect()
    assert all(r.kept for r in got if r.doc_id == 9002) and not any(r.kept for r in got if r.source == "rotten")
    assert all(r.kept != r.base_failed for r in got if r.source.startswith("h"))


def test_one_host_and_repeated_rows(spark):
    good = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, good, "a"), (1, "x", "a"), (1, "x", "a"), (1, good, "a"), (None, good, "a")], "doc_id long, text string, source string")
    got = m.judge(df).collect()
    assert {round(r.host_rate, 9) for r in got} == {0.4} and sum(r.kept for r in got) == 3


def test_no_rows(spark):
    assert m.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
