"""Text features, classifiers and their scores with Spark's own ML operators where it has them.

Term weights follow the usual smoothed form: idf = ln((1 + n) / (1 + df)) + 1, rows scaled to length 1. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialforge.functions import linear, terms
from trialforge.functions.lineage import materialize, together
from trialforge.functions.partitions import spread
from trialforge.functions.text import WHITE_SPACE

# Words that mark a text of mixed sentiment, and the labels of the two extremes.
MIXED = ("still", "mostly", "acceptable", "partial", "rough", "yet", "but")
EXTREME = (0, 4)


def word_tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\w\w+)"), 1)


def _windows(size: Column, k: int, cut) -> Column:
    """The pieces that `cut` makes at each start of a window of k among `size` places; none if there are fewer."""
    return F.when(size >= k, F.transform(F.sequence(F.lit(1), size - (k - 1)), lambda i: cut(i))).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of 1 to n tokens."""

    def runs(k: int) -> Column:
        return _windows(F.size(tokens), k, lambda i: F.array_join(F.slice(tokens, i, k), " "))

    return F.concat(*[runs(k) for k in range(1, n + 1)])


def char_ngrams(text: Column, least: int, most: int) -> Column:
    """Runs of `least` to `most` characters within words, which any white space parts, padded with a space on both sides. A padded word
    shorter than `least` is one run; longer runs than a padded word don't occur in it."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{WHITE_SPACE}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(k: int) -> Column:
        return F.flatten(F.transform(padded, lambda w: _windows(F.length(w), k, lambda i: F.substring(w, i, F.lit(k)))))

    short = F.filter(padded, lambda w: F.length(w) < least)
    return F.concat(short, *[runs(k) for k in range(least, most + 1)])


def tf_idf(docs: DataFrame, key: str, terms: Column, min_df: int = 1) -> DataFrame:
    """key, term, tf and the scaled weight. Document frequencies are counted over all documents."""
    tf = docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    weighted = tf.join(df, "term").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, key).select(key, "term", "tf", (F.col("w") / F.col("norm")).alias("weight"))


def slice_mask(text: Column, label: Column) -> tuple[Column, Column]:
    """Whether a row is of extreme polarity, and whether its text holds a word of mixed sentiment, also as part of another."""
    mixed = F.lit(False)
    for w in MIXED:
        mixed = mixed | F.contains(text, F.lit(w))
    return F.coalesce(label.isin(*EXTREME), F.lit(False)), F.coalesce(mixed, F.lit(False))


def macro_scores(predictions: DataFrame, group: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Macro F1 over the labels in truth or guess, accuracy and count of each group, from its confusion counts."""
    group = list(group)
    cells = predictions.groupBy(*group, truth, guess).agg(F.count(F.lit(1)).alias("n"))
    ends = cells.select(*group, "n", F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col(guess).alias("label"), F.lit(False).alias("is_truth")))).alias("e"), (F.col(truth) == F.col(guess)).alias("hit"))
    per = ends.groupBy(*group, "e.label").agg(F.sum("n").alias("both"), F.sum(F.when(F.col("hit") & F.col("e.is_truth"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("e.is_truth"), F.col("n")).otherwise(0)).alias("support"))
    # 2 tp / (truth + guess)
    return per.groupBy(*group).agg(F.avg(2.0 * F.col("tp") / F.col("both")).alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.sum("support").alias("n_rows"))


def vectors(rows: DataFrame, fit_on: Column, words: int = 2000, min_df: int = 2, n: int = 2, chars: tuple[int, int] | None = (3, 5), weigh: bool = True) -> DataFrame | terms.Counts:
    """rows with `features` in place of their `text`: scaled weights of the `words` commonest runs of 1 to n words, and of half as many runs
    of characters. Terms and their weights are taken from the rows of fit_on only. Counts are written to the shared folder once; the
    weights are made from them as they are read; without weigh the counts are returned."""
    rest = [c for c in rows.columns if c != "text"]
    lowered = spread(rows.select(*rest, F.coalesce(fit_on, F.lit(False)).alias("_fit"), F.lower(F.coalesce("text", F.lit(""))).alias("_text")))
    kinds = [terms.Kind("words", words, 1, n)] + ([terms.Kind("chars", max(1, words // 2), *chars)] if chars else [])
    counts = terms.counted(lowered, rest, kinds, min_df)
    return terms.weighted(counts, rest) if weigh else counts


def classify(counts: terms.Counts, rest: Sequence[str]) -> DataFrame:
    """kind, the columns `rest` and prediction for each row of `vectors` (label, ..., without weigh) that the classifiers aren't fitted on:
    multinomial logistic regression (20 steps), a linear SVM for each label (10 steps), both regularised by 0.01, and naive Bayes."""
    return linear.guesses(counts, linear.fitted(counts, "label"), counts.table.where("NOT _fit"), list(rest))


def calibrated(prepared: DataFrame, fit_on: Column, folds: int = 2, of: float | None = None) -> DataFrame:
    """Rows of `vectors` with a prediction and the probability of the label `of` (of their own if none is given) from a linear SVM, calibrated by a sigmoid that is
    fitted, for each label, on the margins of rows that the model of their fold hasn't seen; averaged over the folds, scaled to 1."""
    rest = [c for c in prepared.columns if c != "features"]
    parts = prepared.withColumns({"_fit": F.coalesce(fit_on, F.lit(False)), "_fold": F.pmod(F.xxhash64("doc_id"), F.lit(folds))})
    labels = [r["label"] for r in parts.where("_fit").select("label").distinct().orderBy("label").collect()]
    # of two labels one's model is the other's with its sign turned
    models = [(k, y) for k in range(folds) for y in (labels[1:] if len(labels) == 2 else labels)]

    def svm(i: int, k: int, y: float):
        made = LinearSVC(maxIter=10, regParam=0.01, labelCol="_y", rawPredictionCol=f"_raw{i}", predictionCol=f"_p{i}")
        return made.fit(parts.where(F.col("_fit") & (F.col("_fold") != k)).select("features", (F.col("label") == y).cast("double").alias("_y")))

    # a fit for each fold and label, side by side; their margins are told in one reading and written
    scored = parts
    for model in together(*[partial(svm, i, k, y) for i, (k, y) in enumerate(models)]):
        scored = model.transform(scored)
    margins, _ = materialize(scored.select(*rest, "_fit", "_fold", *[vector_to_array(f"_raw{i}")[1].alias(f"_m{i}") for i in range(len(models))]), "margins")

    def sigmoid(i: int, k: int, y: float) -> Column:
        unseen = margins.where(F.col("_fit") & (F.col("_fold") == k)).select(array_to_vector(F.array(f"_m{i}")).alias("_m"), (F.col("label") == y).cast("double").alias("_y"))
        fitted = LogisticRegression(featuresCol="_m", labelCol="_y").fit(unseen)
        return 1.0 / (1.0 + F.exp(-(F.col(f"_m{i}") * F.lit(float(fitted.coefficients[0])) + F.lit(float(fitted.intercept)))))

    p: dict[float, list[Column]] = {y: [] for y in labels}
    for (_, y), c in zip(models, together(*[partial(sigmoid, i, k, y) for i, (k, y) in enumerate(models)])):
        p[y].append(c)
    if len(labels) == 2:
        p[labels[0]] = [1.0 - c for c in p[labels[1]]]
    means = margins.withColumns({f"_mean{j}": sum(p[y][1:], p[y][0]) / folds for j, y in enumerate(labels)})
    every = [F.col(f"_mean{j}") for j in range(len(labels))]
    best, wanted = F.array(*every), F.col("label") if of is None else F.lit(of)
    chosen = F.element_at(F.array(*[F.lit(y) for y in labels]), F.array_position(best, F.array_max(best)).cast("int"))
    of_wanted = F.coalesce(*[F.when(wanted == y, c) for y, c in zip(labels, every)])
    return means.select(*rest, chosen.alias("prediction"), (of_wanted / sum(every[1:], every[0])).alias("probability")).where("probability IS NOT NULL")
