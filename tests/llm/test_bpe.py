"""The forced-boundary encoder against the tokenizers library."""

import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe

PATH = bpe.vocabulary_path()
ODD = [
    "", " ", "'s it's I'LL 'D x'tx", "ΣΑΣ ΟΔΟΣ İx ǅ", "a\x1cb \x85 c\xa0d　e", "é é ́ á",
    "<|endoftext|>hi <|startoftext|><|endoftext|> x<|end", "数字 １２３ ⅷ ² 12", "😀😀 a‍b ﻿", "x" * 5000, "!?" * 300,
    "\U00016ea9 \U00010d64 \U0001aa55", "ẞ ŉ ﬁ", "ab" * 40 + "zqxj" * 30,
]


LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def same(library, text):
    ids = bpe.encoder(PATH).encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.encoder(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    same(library, text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(text):
    same(LIBRARY, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.sampled_from(ODD)), max_size=8))
def test_many_texts(texts):
    enc = bpe.ForcedBoundaryBPE.__new__(bpe.ForcedBoundaryBPE)
    enc.__dict__ |= bpe.encoder(PATH).__dict__ | {"_chunks": {}, "_older": {}}
    assert enc.encode_many(texts) == [np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_cuts_are_certain():
    enc = bpe.encoder(PATH)
    word = "zqxjthstßqwé".encode()
    assert b"".join(enc.fragments(word)) == word and len(enc.fragments(word)) > 1
    whole = list(enc._inner[b] for b in word[:-1]) + [enc._last[word[-1]]]
    assert enc._merge_long(whole) == np.frombuffer(enc._word(word), "<u4").tolist()


def test_documents(spark, sf_dir, library):
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        got = rows[d.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, [9], "x"), (1, None, [9], "x"), (2, "Ab", None, None)], "doc_id long, text string, ids array<int>, decoded string")
    out = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).orderBy("doc_id").collect()
    assert [r.ids for r in out][:2] == [[], []] and out[2].decoded == "ab</w>" and out[0].decoded == ""
    assert bpe.decode_documents(bpe.encode_documents(df.limit(0), PATH), PATH).count() == 0


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": None}, {"added_tokens": [{"content": "[PAD]", "id": 1}]}, {"model": spec["model"] | {"end_of_word_suffix": None}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.ForcedBoundaryBPE(str(other))


def test_blanks_split_texts_as_in_python():
    blanks = [chr(k) for k in range(0x110000) if chr(k).isspace()]
    texts = [f"a{b}b" for b in blanks] + [f"{b}x{b}" for b in blanks]
    enc = bpe.ForcedBoundaryBPE(PATH)
    assert enc.encode_many(texts) == [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
