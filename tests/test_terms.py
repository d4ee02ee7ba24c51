"""Terms of texts: the same vectors as Spark's own stages make, in time that grows with the text."""

import re
import sys
import time

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
from pyspark.sql import functions as F

from trialforge.functions import terms
from trialforge.functions.text import WHITE_SPACE
from trialforge.operators import text_ml

TEXTS = [
    "The loss fell, the loss fell again by 0.42.", "Verlust fällt; ΟΔΟΣ größere Schritte", None, "", "  ", "a b", "損失が下がった。 損失が下がった。",
    "the loss rose\x1fthen fell again", "loss=0.42 loss=0.42 step_1 step_1", "\U0001f600\U0001f600\U0001f600\U0001f600 the loss", "x\0y\0z\0", "fell the",
]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, float(i % 2), i % 4 != 3) for i, t in enumerate(texts)], "doc_id long, text string, label double, train boolean")


def parts(vector, bounds):
    """The weights of each kind, in order of size."""
    dense = vector.toArray()
    return [sorted(x for x in dense[a:b].tolist() if x) for a, b in bounds]


@pytest.mark.parametrize(("n", "chars", "min_df"), [(2, (3, 4), 1), (3, (3, 5), 2), (1, (5, 6), 1), (2, (1, 2), 1)])
def test_vectors_as_of_sparks_stages(spark, n, chars, min_df):
    docs = rows(spark)
    inputs = {"w": text_ml.ngrams(text_ml.word_tokens(F.col("text")), n), "c": text_ml.char_ngrams(F.col("text"), *chars)}
    stages = [s for k in "wc" for s in (CountVectorizer(inputCol=k, outputCol=k + "c", vocabSize=5000, minDF=min_df), IDF(inputCol=k + "c", outputCol=k + "i"), Normalizer(inputCol=k + "i", outputCol=k + "n"))]
    flat = docs.withColumns(inputs)
    model = Pipeline(stages=stages).fit(flat.where("train"))
    wanted = {r.doc_id: (r.wn, r.cn) for r in model.transform(flat).collect()}
    got = {r.doc_id: r.features for r in text_ml.vectors(docs, F.col("train"), words=10_000, min_df=min_df, n=n, chars=chars).collect()}
    sizes = [len(model.stages[0].vocabulary), len(model.stages[3].vocabulary)]
    assert got.keys() == wanted.keys() and all(v.size == sum(sizes) for v in got.values())
    for i, v in got.items():
        made = parts(v, [(0, sizes[0]), (sizes[0], sum(sizes))])
        for x, w in zip(made, wanted[i]):
            assert x == pytest.approx(parts(w, [(0, w.size)])[0])


def test_the_commonest_terms_by_uses_then_length_then_alphabet(spark):
    lowered = spark.createDataFrame([("bb aa bb aa cc",), ("bb aa dd",)], "_text string")
    words, chars = terms.commonest(lowered, [terms.Kind("words", 4, 1, 3), terms.Kind("chars", 3, 3, 4)])
    assert words == ["aa", "bb", "bb aa", "cc"]
    assert chars == [" aa", " bb", "aa "]


def test_white_space_is_what_split_parts_at():
    assert {c for c in map(chr, range(sys.maxunicode + 1)) if not c.split()} == set(WHITE_SPACE)
    assert re.fullmatch(terms.WORD, "größe") is None


def test_a_long_text_takes_time_in_proportion(spark):
    text = " ".join(f"word{i % 997} z{i}" for i in range(20_000))
    docs = rows(spark, [text, "short text", text[::-1], "other text"])
    began = time.perf_counter()
    assert text_ml.vectors(docs, F.col("train"), words=800, min_df=1, n=2, chars=(3, 4)).where("doc_id < 4").count() == 4
    assert time.perf_counter() - began < 60
