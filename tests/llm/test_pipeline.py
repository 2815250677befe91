"""The pipeline's stages one after another, each held against what it has to do."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe, exact_dedup, mixing, simhash, toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs]
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, seen[-1], sf_dir)
        out = spark.createDataFrame(out.collect(), out.schema)
        seen.append(out)
    assert all(s.columns == columns for s in seen[:-1])
    ids = lambda df: {r.doc_id for r in df.collect()}
    model = toxicity.train(seen[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(seen[1]) == {r.doc_id for r in toxicity.score(seen[0], model).collect() if r.score < 0.5}
    assert ids(seen[2]) == {r.keep_id for r in exact_dedup.exact_dedup(seen[1]).collect()}
    assert ids(seen[3]) == {r.component_id for r in simhash.near_components(seen[2]).collect()}
    drawn = Counter(r.doc_id for r in mixing.replicate(seen[3]).collect())
    assert Counter(r.doc_id for r in seen[4].collect()) == drawn == Counter(r.doc_id for r in seen[5].collect())
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r in seen[5].collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
