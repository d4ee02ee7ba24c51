import random

import pytest

from trialforge.llm import tokenizer

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return tokenizer.load(tokenizer.vocabulary_path())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    r = random.Random(3)
    alphabet = "aab  \n\t.,'-_=0123456789ßéñ中文かな한国😀​́﻿\x00"
    made = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(300)]
    return made + ["", " ", "a", "aaaaaaa", "<|endoftext|>", " don't WE'LL", "a" * 5000, "ab" * 3000, "=-" * 700, "\n" * 300, " " * 999 + "x", "😀" * 400, "the " * 900]


def test_ids_equal_the_public_library(model, reference):
    all_ = texts()
    assert [x.tolist() for x in model.encode_batch(all_)] == reference(all_)


def test_round_trip(model):
    for t, ids in zip(texts(), model.encode_batch(texts())):
        assert model.decode(ids.tolist()) == t


def test_long_words_merge_as_short_ones_do(model):
    for word in (b"abcabcabc" * 20, b"aaaa" * 50, bytes(range(33, 127)) * 2):
        assert model._long(word).tolist() == model._rounds([word])[0].tolist()


def test_table(spark, reference):
    rows = [(1, "Hello  world", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "long " * 40_000, "x", 1), (1, "Hello  world", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k string, ids int")
    out = tokenizer.encode(df)
    assert dict(out.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    got = [(r.doc_id, r.ids) for r in out.collect()]
    assert sorted(got, key=lambda x: x[0]) == sorted([(i, reference([t or ""])[0]) for i, t, *_ in rows], key=lambda x: x[0])
    counts = {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df).collect()}
    assert counts[2] == counts[3] == 0 and counts[4] == len(reference([rows[3][1]])[0])


def test_empty_table(spark):
    assert tokenizer.encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_whole_test_table_equals_the_public_library(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.ids for r in tokenizer.encode(docs).collect()}
    assert got == dict(zip(want, reference(list(want.values()))))
