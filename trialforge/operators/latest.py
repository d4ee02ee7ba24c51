"""Latest record of each key and one-pass group statistics. Ties end in a unique order column; null keys form a key of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_record(log: DataFrame, key: str, order: list[str], seq: str) -> DataFrame:
    """The last row of each key by `order`, with first_seq, the key's first appearance. One partial and one final aggregation."""
    rest = [c for c in log.columns if c != key]
    out = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"), F.min(seq).alias("first_seq"))
    return out.select(key, "_x.*", "first_seq")


def run_statistics(runs: DataFrame, key: str, most_relative_std: float) -> DataFrame:
    """For each candidate the number of attempts, mean scores, relative standard deviation, stability and whether all were valid."""
    mean, spread = F.avg("selection_eval"), F.stddev_pop("selection_eval")
    out = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("search_eval").alias("mean_search"),
        mean.alias("mean_selection"),
        F.count("selection_eval").alias("_n"),
        spread.alias("_sd"),
        F.every(F.coalesce("valid", F.lit(False))).alias("all_valid"),
        F.max("seq").alias("last_seq"),
    )
    relative = F.when(F.col("_n") >= 2, F.when(F.abs("mean_selection") > 1e-9, F.col("_sd") / F.abs("mean_selection")).otherwise(0.0))
    out = out.withColumn("relative_std", relative)
    return out.withColumn("stable", F.col("relative_std").isNull() | (F.col("relative_std") <= most_relative_std)).drop("_n", "_sd")


def test_means(scores: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mean score of each test with the flag of its first appearance; scores has test, score and decisive."""
    first = F.min_by("decisive", order)
    return scores.groupBy(*keys, "test").agg(F.avg("score").alias("mean_score"), first.alias("decisive"))


def last_n(rows: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group. The limit is applied in each map task before the shuffle, so hot groups are no burden."""
    w = W.partitionBy(*group).orderBy(F.col(order).desc())
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def best_n(rows: DataFrame, group: list[str], score: Column, order: str, n: int) -> DataFrame:
    """The n rows of each group with the highest score, nulls last and earlier rows first among equal ones."""
    w = W.partitionBy(*group).orderBy(score.desc_nulls_last(), F.col(order))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def best_overall(rows: DataFrame, score: Column, order: str, n: int) -> DataFrame:
    """The n best rows of all: each task keeps its n best, one merges them."""
    top = rows.withColumn("_score", score).orderBy(F.col("_score").desc_nulls_last(), order).limit(n)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.col("_score").desc_nulls_last(), order))).drop("_score")
