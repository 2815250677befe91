"""Stages from raw documents to a tokenised training mixture.

Each stage gets all that the one before it kept, as a written table, and decides by
row: what leaves, leaves for good.

Edge cases: a null text counts as empty, and an empty one is clean, is one text among
the exact copies, has the fingerprint zero, and has no ids; of equal texts the row with
the smallest doc_id stays (ids before nulls, then any one row), of near copies likewise,
so repeated rows leave one and texts that share an id are decided each by itself; a
null source is a source of its own in the mixture; very long texts are read whole by
every stage; columns beside those of ``documents`` are carried through, but ``ids``,
``decoded`` and ``n_tokens`` are replaced by those of the last stage; without labels of
both kinds no document is toxic unless most labels are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, exact_dedup, mixing, simhash, toxicity
from sparkloom.llm.shared import stage

#: Not every stage can be said in SQL, so there is no SQL for the whole (see ORACLE_SQL).
STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("exact dedup", exact_dedup.keep_first),
    ("SimHash near-dedup", simhash.one_of_each),
    ("mixing sources to target weights", mixing.mix),
    ("BPE encoding and decoding", bpe.encode_stage),
]
#: The first stage is a trained classifier: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, "pipeline")
    return docs
