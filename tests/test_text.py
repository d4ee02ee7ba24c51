"""Text features by their rules, and what the classifiers reach on texts that they haven't seen."""

from pyspark.sql import functions as F

from trialforge.functions.partitions import spread
from trialforge.operators.text_ml import char_ngrams
from trialforge.plans import texts

FOLDER = "/root/testdata/sf0.001"


def test_character_runs_within_words(spark):
    df = spark.createDataFrame([("a\u2003bcd\u00a0E",), (None,), ("  ",)], "t string")
    got = [r.g for r in df.select(char_ngrams(F.col("t"), 4, 5).alias("g")).collect()]
    assert sorted(got[0]) == sorted([" a ", " e ", " bcd", "bcd ", " bcd "]) and got[1:] == [[], []]


def test_classifiers_on_held_out_texts(spark):
    scores = {r.kind: r for r in texts.text_scores(spark, FOLDER).collect()}
    assert set(scores) == {"logistic", "svm", "bayes"}
    assert all(r.accuracy >= 0.9 and r.macro_f1 >= 0.8 for r in scores.values())


def test_calibrated_probabilities(spark):
    rows = texts.calibrated_text(spark, FOLDER).collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    mean = lambda y: sum(r.probability for r in rows if r.label == y) / max(1, sum(r.label == y for r in rows))
    assert mean(1) > 0.8 > 0.2 > mean(0)


def test_small_scans_are_spread(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert f"Repartition {3 * cores}" in spread(docs)._jdf.queryExecution().optimizedPlan().toString()
    big = spark.range(10_000_000)  # 80 MB by its statistics
    assert "Repartition" not in spread(big)._jdf.queryExecution().optimizedPlan().toString()
