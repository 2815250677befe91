"""The pipeline over odd rows: null ids, repeated ids and rows, clashing columns, and no rows."""

import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe

WORDS = random.Random(2)
PROSE = [" ".join(WORDS.choice("amber brook cedar delta ember fjord grove heath inlet jetty".split()) + str(WORDS.randint(0, 99)) for _ in range(40)) for _ in range(30)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, __maybe int, replica int"


def rows():
    out = [(k, PROSE[k], "en", f"s{k % 3}", 1, "i", 1, 7) for k in range(20)]
    out += [(100 + k, "vile slur vile slur " * 5 + str(k), "en", "s0", 1, "i", 1, 7) for k in range(8)]
    out += [(0, PROSE[0], "en", "s0", 1, "i", 1, 7), (200, PROSE[1], "en", "s1", 1, "i", 1, 7)]  # a repeated row, an exact copy
    out += [(2, PROSE[21], "en", "s2", 1, "i", 1, 7), (None, PROSE[22], "en", None, 1, "i", 1, 7), (None, PROSE[22], "en", None, 1, "i", 1, 7)]  # an id of two texts, null ids
    out += [(300, PROSE[3] + " coda", "en", "s0", 1, "i", 1, 7), (301, None, None, None, None, None, None, None), (302, "", "en", "s1", 0, "", 0, 0)]
    return out


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k >= 100)) for k in [*range(20), *range(100, 108)]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    return str(tmp_path)


def test_odd_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, []
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, tables)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        kept.append(Counter((r.doc_id, r.text) for r in docs.collect()))
    clean = Counter((r[0], r[1]) for r in rows() if not (r[1] or "").startswith("vile"))
    assert kept[0] == clean
    # exactly one row of equal texts, the smallest id first; no text is lost
    best = {}
    for doc_id, text in clean:
        key = text or ""
        if key not in best or (doc_id is None, doc_id or 0) < (best[key] is None, best[key] or 0):
            best[key] = doc_id
    assert Counter({(i, t): 1 for t, i in best.items()}) == Counter({(i, t or ""): n for (i, t), n in kept[1].items()})
    # near copies go, every other text stays, each once
    assert kept[1] - kept[2] <= Counter({(300, PROSE[3] + " coda"): 1, (302, ""): 1, (301, None): 1})
    assert {t for _, t in kept[3]} <= {t for _, t in kept[2]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = last.collect()
    assert len(got) == sum(kept[3].values()) and set(columns) <= set(last.columns)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_no_rows(spark, tables):
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0
