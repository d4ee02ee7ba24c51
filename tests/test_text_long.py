"""The classifiers over a table with a long text: each held-out text has a prediction by each of them, in time that grows with the text."""

import time

import pytest
from pyspark.sql import functions as F
from test_text import FOLDER

from trialforge.plans import texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("wort"), i % 997)), " ")
    docs.withColumn("text", F.when(F.col("doc_id") == docs.where("lang = 'de' AND text IS NOT NULL").agg(F.min("doc_id")).first()[0], long).otherwise(F.col("text"))).write.parquet(f"{d}/documents.parquet")
    return d


def test_classifiers_with_a_long_text(spark, folder):
    held_out = {r.doc_id for r in texts._labelled(spark, folder).where("not train").collect()}
    began = time.perf_counter()
    rows = texts.text_classifiers(spark, folder).collect()
    assert time.perf_counter() - began < 120
    assert sorted((r.kind, r.doc_id) for r in rows) == sorted((k, i) for k in ("bayes", "logistic", "svm") for i in held_out)


def test_scores_with_a_long_text(spark, folder):
    held_out = texts._labelled(spark, folder).where("not train").count()
    began = time.perf_counter()
    scores = texts.text_scores(spark, folder).collect()
    assert time.perf_counter() - began < 120
    assert {r.kind: r.n_rows for r in scores} == dict.fromkeys(("bayes", "logistic", "svm"), held_out)
