"""Classifiers fitted side by side: the same models as Spark's own, in few readings of the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.sql import functions as F
from test_catalogue import FOLDER

from trialforge.functions import linear, terms
from trialforge.operators import text_ml
from trialforge.plans import texts

# made once there is a session
OWN = {
    "logistic": lambda: LogisticRegression(maxIter=20, regParam=0.01),
    "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=10, regParam=0.01)),
    "bayes": lambda: NaiveBayes(modelType="multinomial"),
}


def counted(rows):
    return text_ml.vectors(rows, F.col("train"), **texts.FEATURES, weigh=False)


def guessed(counts):
    return {(r.kind, r.doc_id): r.prediction for r in text_ml.classify(counts, ["doc_id"]).collect()}


def made(spark, labels, words):
    """Texts of their label's words; every fourth is held out."""
    texts_of = [(i, " ".join(words[y][(i * k) % len(words[y])] for k in range(1, 6)), float(y), i % 4 != 3) for i, y in enumerate(labels)]
    return spark.createDataFrame(texts_of, "doc_id long, text string, label double, train boolean")


WORDS = [["loss", "fell", "again", "model", "rate"], ["verlust", "fiel", "wieder", "modell", "rate"], ["perte", "tombe", "encore", "modele", "taux"]]


@pytest.mark.parametrize("labels", [[0, 1, 2, 1, 0, 2, 2] * 6, [0, 1, 1, 0, 1] * 8, [0, 2, 0, 0, 2] * 8], ids=["three", "two", "one absent"])
def test_predictions_as_of_sparks_models(spark, labels):
    counts = counted(made(spark, labels, WORDS))
    prepared = terms.weighted(counts, ["doc_id", "label", "train"])
    got = guessed(counts)
    for kind, own in OWN.items():
        if kind == "svm" and len(set(labels)) <= max(labels):
            continue  # Spark's fails where a label is absent
        model = own().fit(prepared.where("train"))
        wanted = {r.doc_id: int(r.prediction) for r in model.transform(prepared.where("NOT train")).collect()}
        if kind == "bayes":  # Spark's gives the place among the labels that it has seen
            wanted = {i: sorted(set(labels))[p] for i, p in wanted.items()}
        assert {i: p for (k, i), p in got.items() if k == kind} == wanted


def test_weights_as_of_sparks_models(spark):
    counts = counted(texts._labelled(spark, FOLDER))
    train = terms.weighted(counts, ["label", "train"]).where("train").cache()
    model, idf = linear.fitted(counts, "label"), counts.idf[counts.kept]

    def of(kind):
        a, b, _ = model.kinds[kind]
        return model.weights[:, a:b], model.bias[a:b]

    weights, bias = of("logistic")
    own = OWN["logistic"]().fit(train)
    matrix, at = own.coefficientMatrix.toArray(), own.interceptVector.toArray()
    assert weights == pytest.approx(matrix.T * idf[:, None], abs=1e-6)
    assert bias - bias.mean() == pytest.approx(at - at.mean(), abs=1e-6)
    weights, bias = of("svm")
    for y in range(2):
        own = LinearSVC(maxIter=10, regParam=0.01, labelCol="y").fit(train.withColumn("y", (F.col("label") == y).cast("double")))
        assert weights[:, y] == pytest.approx(own.coefficients.toArray() * idf, abs=1e-6)
        assert bias[y] == pytest.approx(own.intercept, abs=1e-6)
    weights, bias = of("bayes")
    own = OWN["bayes"]().fit(train)
    assert weights == pytest.approx(own.theta.toArray().T * idf[:, None])
    assert bias == pytest.approx(own.pi.toArray())
    train.unpersist()


@pytest.mark.parametrize(("labels", "words"), [([2] * 8, WORDS), ([0, 1] * 8, [["."], ["-"]])], ids=["one label", "no words"])
def test_little_to_learn(spark, labels, words):
    got = guessed(counted(made(spark, labels, words)))
    assert len(got) == 3 * (len(labels) // 4) and set(got.values()) <= set(labels)


def test_nothing_to_fit_on_is_an_error(spark):
    with pytest.raises(ValueError, match="no rows"):
        guessed(counted(made(spark, [0, 1, 0, 1], WORDS).withColumn("train", F.lit(False))))


def test_many_partitions_are_added_on_executors(spark, monkeypatch):
    sums = spark.createDataFrame([(np.full(6, float(i)).tobytes(),) for i in range(8)], "sums binary").repartition(8)
    wanted = np.full((2, 3), 28.0)
    for most in (64, 4, 2):
        monkeypatch.setattr(linear, "AT_ONCE", most)
        assert (linear._total(sums, 8, (2, 3)) == wanted).all()


def test_classifiers_take_few_readings(spark):
    jobs = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    rows = texts.text_classifiers(spark, FOLDER).collect()
    # a reading for each step of the slowest model, and a dozen for the terms; a reading for each model's steps were some hundreds
    assert rows and len(jobs() - before) < 80
