"""The toxicity classifier: held-out accuracy, rules of what is learnt, and small tables."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import toxicity as m


def test_held_out_rows_of_every_language(spark):
    """Held-out toxic rows of every language, most of which use no word that clean texts lack."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = m.op9_toxicity(spark, sf).join(labels, "doc_id").join(langs, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.predicted == r.toxic for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    found = {}
    for lang in ("en", "de", "fr", "es"):
        own = [r.predicted for r in rows if r.toxic and r.lang == lang]
        clean = [r.predicted for r in rows if not r.toxic and r.lang == lang]
        found[lang] = (sum(own), len(own), sum(clean), len(clean))
    print(found)
    assert all(hit / n >= 0.85 and alarms / clean < 0.03 for hit, n, alarms, clean in found.values()), found
    assert sum(x[0] for x in found.values()) >= 0.9 * sum(x[1] for x in found.values()), found


def test_only_own_rows_are_learnt(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(7, "a") for _ in range(30)] + [(None, "none")], "doc_id long, text string")
    got = sorted((r.text, r.label) for r in m.training_rows(docs, labels).collect())
    assert got == sorted(("a" if k == 7 else f"text {k}", k % 2) for k in range(40) if zlib.crc32(str(k).encode()) % 5)


def test_bound_holds_for_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "MAX_TRAINING", 5)
    labels = spark.range(40).selectExpr("id doc_id", "id % 2 toxic")
    docs = spark.range(400).selectExpr("id % 40 doc_id", "cast(id as string) text")
    assert m.training_rows(docs, labels).count() == 5


def test_bound_holds_for_values(spark, monkeypatch):
    """Texts are taken in the order of the hash while their values fit; a very long one counts as all slots."""
    labels = spark.range(1, 60).selectExpr("id doc_id", "id % 2 toxic")
    docs = spark.range(1, 60).selectExpr("id doc_id", "repeat('ab ', cast(id as int) * 10) text").unionByName(spark.range(1).selectExpr("60l doc_id", "repeat('x y', 600000) text"))
    whole = m.training_rows(docs, labels).collect()
    monkeypatch.setattr(m, "MAX_VALUES", 9_000)
    some = m.training_rows(docs, labels).collect()
    assert 0 < len(some) < len(whole) and sum(3 * len(r.text) for r in some) <= 9_000 and {r.text for r in some} < {r.text for r in whole}
    monkeypatch.setattr(m, "MAX_VALUES", 3 << m.BITS)
    assert any(len(r.text) > 1_000_000 for r in m.training_rows(docs, labels.unionByName(spark.createDataFrame([(60, 1)], "doc_id long, toxic long"))).collect()) == (zlib.crc32(b"60") % 5 != 0)


def test_settings_by_cross_validation(spark):
    rows = [(f"mud and dirt {k} mud", 1) if k % 3 == 0 else (f"sun and air {k} sun", 0) for k in range(90)]
    training = spark.createDataFrame(rows, "text string, label int")
    got = m.cross_validate(training, [(10.0, 1e-3), (10.0, 100.0)], folds=3).collect()
    assert {(r.smoothing, r.penalty, r.toxic) for r in got} == {(10.0, 1e-3, 30), (10.0, 100.0, 30)}
    strong, weak = sorted(got, key=lambda r: r.loss)
    assert (strong.penalty, strong.found, strong.alarms) == (1e-3, 30, 0) and weak.loss > strong.loss
    assert m.cross_validate(training.limit(0), [(1.0, 1.0)]).count() == 0


def slots_by_text(texts):
    """Value of every slot of every text, by plain counting of n-grams."""
    slots = m.Slots()
    out = []
    for text in texts:
        clean = " " + " ".join(text.lower().split()) + " "
        count = {}
        for n in m.ORDERS:
            for k in range(len(clean) - n + 1):
                alone = np.array([ord(c) for c in clean[k : k + n]], np.uint32)
                h = alone[0]
                for c in alone[1:]:
                    h = np.uint32((int(h) * 0x9E3779B1 + int(c)) & 0xFFFFFFFF)
                mixed = (int(h) ^ (int(h) >> 15)) * (0x85EBCA6B + 2 * n) & 0xFFFFFFFF
                slot = mixed >> (32 - m.BITS)
                count[slot] = count.get(slot, 0) + 1
        out.append({s: round(math.log1p(m.PER * c / len(clean)) * m.UNITS) / m.UNITS for s, c in count.items()})
        got = dict(zip(*(x.tolist() for x in slots.counted(text))))
        assert {s: v / m.UNITS for s, v in got.items()} == out[-1]
    return out


def test_ratios_and_fit_by_brute_force(spark, monkeypatch):
    texts = [f"bad mud {'mud ' * (k % 4)}day {k}" if k % 3 == 0 else f"fine {'sun ' * (k % 5)}day {k}" for k in range(24)]
    label = np.array([float(k % 3 == 0) for k in range(24)])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(x)) for k, x in enumerate(label)], "doc_id long, toxic int")
    monkeypatch.setattr(m, "held_out", lambda c: F.lit(False))
    values = slots_by_text(texts)
    toxic, clean = {}, {}
    for v, x in zip(values, label):
        for s, y in v.items():
            side = toxic if x else clean
            side[s] = side.get(s, 0) + y
    t, c = sum(toxic.values()), sum(clean.values())
    share = t / (t + c)
    ratio = {s: math.log((toxic.get(s, 0) + m.SMOOTHING * share) / t) - math.log((clean.get(s, 0) + m.SMOOTHING * (1 - share)) / c) for s in {*toxic, *clean}}
    got = {r.slot: r.ratio for r in m.log_count_ratios(m.training_rows(docs, labels)).collect()}
    assert got.keys() == ratio.keys() and all(abs(got[s] - ratio[s]) < 1e-9 for s in got)
    names = sorted(ratio)
    x = np.array([[v.get(s, 0) * ratio[s] for s in names] for v in values])
    w, b, moments = np.zeros(len(names)), math.log(8 / 16), [np.zeros(len(names) + 1)] * 2
    for k in range(1, m.STEPS + 1):
        error = 1 / (1 + np.exp(-(x @ w + b))) - label
        grad = np.append(x.T @ error / len(label) + m.PENALTY * w, error.mean())
        moments = [0.9 * moments[0] + 0.1 * grad, 0.999 * moments[1] + 0.001 * grad**2]
        change = m.STEP * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.999**k)) + 1e-9)
        w, b = w - change[:-1], b - change[-1]
    model = m.train(docs, labels)
    slots = m.Slots()
    apart = [abs(model.of(slots, t) - (row @ w + b)) for t, row in zip(texts, x)]
    assert max(apart) < 1e-3, apart


def test_slots_are_distinct():
    slots = m.Slots()
    a, b = slots.counted("Abc abc  ABC")[0], slots.counted("abc abc abc")[0]
    assert len(a) == len(set(a.tolist())) and sorted(a) == sorted(b)
    assert len(slots.counted(None)[0]) == len(slots.counted("")[0]) == 0 and len(slots.counted("é")[0]) > 0


def small(spark, toxic):
    docs = spark.createDataFrame([(k, "you idiot scum" if k in toxic else f"a fine day {k}", 1) for k in range(60)] + [(100, None, 1), (101, "", 1), (None, "idiot scum", 1), (5, "x", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k in toxic), 9) for k in range(60)], "doc_id long, toxic int, text int")
    return docs, labels


def test_small_tables(spark):
    docs, labels = small(spark, set(range(0, 60, 3)))
    scores = {(r.doc_id): r.score for r in m.score(docs, m.train(docs, labels)).collect()}
    assert scores[3] > 0.5 > scores[4] and scores[None] > 0.5 and abs(scores[100] - scores[101]) < 1e-9
    for bad in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("toxic", F.lit(1))):
        assert len({r.score for r in m.score(docs, m.train(docs, bad)).collect()}) == 1
    assert m.score(docs.limit(0), m.train(docs, labels)).count() == 0


def test_stage_keeps_clean_documents(spark, tmp_path):
    docs, labels = small(spark, set(range(0, 60, 3)))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = m.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and not [r for r in kept.collect() if "idiot" in (r.text or "")] and kept.count() == 43


def test_frequency_counts(spark):
    """All texts have the same n-grams: only how often they occur differs."""
    words = lambda k: "mud " * (30 + k % 5 if k % 3 == 0 else 3) + "sun " * (3 if k % 3 == 0 else 30 + k % 5)
    docs = spark.createDataFrame([(k, words(k)) for k in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in m.score(docs, m.train(docs, labels)).collect()}
    assert all((got[k] >= 0.5) == (k % 3 == 0) for k in range(90))


def test_labels_of_one_kind_or_none(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(12)], "doc_id long, text string")
    for rows, toxic in (([], 0), ([(k, 0) for k in range(12)], 0), ([(k, 1) for k in range(12)], 1)):
        folder = f"{tmp_path}/{len(rows)}-{toxic}"
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        assert {r.predicted for r in m.op9_toxicity(spark, folder).collect()} == {toxic}
        assert m.drop_toxic(spark, docs, folder).count() == (0 if toxic else 12)
