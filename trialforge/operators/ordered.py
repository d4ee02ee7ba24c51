"""Analytics that depend on the order of a log: leaders, champions with a margin, plateau counters, ledgers and trends.

Every operator takes an order column that is numeric and unique within a group. Running values of hot groups are made in slices
(functions.skew.running). Null scores never lead, win or count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from trialforge.functions.lineage import materialize
from trialforge.functions.skew import cut_of, rolling, running


def prefix_leaders(rows: DataFrame, group: str, order: str, score: Column, zero_is_missing: bool = False) -> DataFrame:
    """Rows whose score is strictly above all earlier ones of the group; ties keep the incumbent.

    zero_is_missing follows engines that take a leader of exactly 0 for none: then any score that comes next beats it, so the bar is
    what was reached since the last such 0 that led.
    """
    flat = rows.withColumn("_s", score)
    if not zero_is_missing:
        seen = running(flat, group, order, F.col("_s"), "max", "bar")
        return seen.where(F.col("_s").isNotNull() & (F.col("bar").isNull() | (F.col("_s") > F.col("bar")))).drop("_s")
    # a 0 leads only over negative scores, and whatever follows it restarts the bar: segments are cut at the zeros that led
    by_order = cut_of(flat, group, order)
    seen = running(flat, group, order, F.col("_s"), "max", "_max", cut=by_order)
    zero_led = (F.col("_s") == 0) & (F.col("_max").isNull() | (F.col("_max") <= 0))
    cut = running(seen, group, order, F.when(zero_led, F.col(order)), "max", "_cut", cut=by_order)
    cut = cut.withColumn("_seg", F.concat_ws(":", F.col(group).cast("string"), F.coalesce(F.col("_cut"), F.lit(-1)).cast("string")))
    again = running(cut, "_seg", order, F.col("_s"), "max", "bar")
    return again.where(F.col("_s").isNotNull() & (F.col("bar").isNull() | (F.col("_s") > F.col("bar")))).drop("_s", "_max", "_cut", "_seg")


def champion_fold(rows: DataFrame, group: str, order: str, mean: str, eligible: Column, margin: float) -> DataFrame:
    """Adds champion_before: the mean of the group's champion before each row, null if it has none yet.

    An eligible row becomes champion if its mean is above the champion's by more than the margin. Such a row is always above all
    eligible means before it (had an earlier one been higher by then, it would have become champion), so only those records, few
    of all rows, go through the sequential fold, in a stream sorted by group and order that keeps one number for each task.
    """
    # the rows are read several times and often come from an aggregation
    flat, _ = materialize(rows.withColumn("_e", F.when(eligible, F.col(mean))), "fold")
    cut = cut_of(flat, group, order)
    records = running(flat, group, order, F.col("_e"), "max", "_bar", cut=cut).where(F.col("_e").isNotNull() & (F.col("_bar").isNull() | (F.col("_e") > F.col("_bar"))))
    small = records.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col("_e").alias("m")).repartition("g").sortWithinPartitions("g", "o")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, champion = None, None
        for batch in batches:
            taken = []
            for g, m in zip(batch["g"], batch["m"]):
                if g != now:
                    now, champion = g, None
                won = champion is None or m > champion + margin
                champion = m if won else champion
                taken.append(won)
            yield batch[taken]

    won = small.mapInPandas(fold, small.schema).withColumnsRenamed({"g": "_wg", "o": "_wo", "m": "_wm"})
    both = flat.join(won, F.col(group).eqNullSafe(F.col("_wg")) & (F.col(order) == F.col("_wo")), "left").drop("_wg", "_wo")
    return running(both, group, order, F.col("_wm"), "max", "champion_before", cut=cut).drop("_e", "_wm")


def plateau_counter(rows: DataFrame, group: str, order: str, promoted: Column, rejected: Column) -> DataFrame:
    """Adds plateau: rejections since the group's last promotion, this row included; other rows leave it as it is."""
    cut = cut_of(rows, group, order)
    total = running(rows, group, order, rejected.cast("long"), "sum", "_all", current=True, cut=cut)
    at_promotion = running(total, group, order, F.when(promoted, F.col("_all")), "max", "_then", current=True, cut=cut)
    return at_promotion.withColumn("plateau", F.col("_all") - F.coalesce("_then", F.lit(0).cast("long"))).drop("_all", "_then")


def ledger(entries: DataFrame, group: str, order: str, amount: Column, initial: int = 0) -> DataFrame:
    """Adds balance: the initial amount and the sum of all entries up to each."""
    return running(entries, group, order, amount.cast("long"), "sum", "_sum", current=True).withColumn("balance", F.col("_sum") + initial).drop("_sum")


def thirds_trend(series: DataFrame, group: str, order: str, score: str, valid: str, step: str, band: float = 0.02) -> DataFrame:
    """A run's trend: the mean of the last third of its valid scored points against that of the first.

    A point counts as valid unless it has valid = false or null; false in the second half of all points makes the run collapsed.
    Groups are single runs; one run's points are sorted by one task.
    """
    every, w_all = W.partitionBy(group), W.partitionBy(group).orderBy(order)
    good = F.coalesce(F.col(valid), F.lit(False)) & F.col(score).isNotNull() & (F.col(score) - F.col(score) == 0)
    flat = series.withColumn("_good", good).withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("_i", F.row_number().over(w_all) - 1)
    flat = flat.withColumn("_gn", F.count_if("_good").over(every)).withColumn("_gi", F.count_if("_good").over(w_all.rowsBetween(W.unboundedPreceding, 0)))
    third = F.greatest(F.lit(1), F.floor(F.col("_gn") / 3))
    mean = lambda c: F.avg(F.when(F.col("_good") & c, F.col(score)))
    failed = F.coalesce(F.col(valid) == F.lit(False), F.lit(False))
    out = flat.groupBy(group).agg(
        F.count(F.lit(1)).alias("checkpoints"),
        F.count_if("_good").alias("valid_checkpoints"),
        mean(F.col("_gi") <= third).alias("_first"),
        mean(F.col("_gi") > F.col("_gn") - third).alias("_last"),
        F.bool_or(failed).alias("_any"),
        F.bool_or(failed & (F.col("_i") >= F.floor(F.col("_n") / 2))).alias("_tail"),
        F.max_by(step, order).alias("last_step"),
    )
    delta = F.col("_last") - F.col("_first")
    none = F.col("valid_checkpoints") == 0
    trend = F.when(none, F.when(F.col("_any"), "collapsed").otherwise("no_signal")).when(F.col("_tail"), "collapsed").when(delta > band, "improving").when(delta < -band, "regressing").otherwise("plateau")
    return out.select(group, "checkpoints", "valid_checkpoints", F.round("_first", 6).alias("first_mean"), F.round("_last", 6).alias("last_mean"), F.round(delta, 6).alias("delta"), trend.alias("trend"), "last_step")


def z_scores(rows: DataFrame, group: str, order: str, score: str, window: int = 20, least: int = 5, sigma: float = 3.0, flat: float = 0.001) -> DataFrame:
    """Adds z_score and surprising: a score against the sample deviation of its group's last `window` rows, itself included. Nulls
    among them shorten the sample; fewer than `least` scores or hardly any deviation surprise nobody."""

    def add(df: DataFrame, w: WindowSpec) -> DataFrame:
        n, mean, dev = F.count(score).over(w), F.avg(score).over(w), F.stddev_samp(score).over(w)
        return df.withColumn("z_score", F.when((n >= least) & (dev >= flat), F.abs(F.col(score) - mean) / dev))

    return rolling(rows, group, order, window, add).withColumn("surprising", F.coalesce(F.col("z_score") > sigma, F.lit(False)))


def repeated_failures(rows: DataFrame, group: str, order: str, failure: str, classes: list[str], n: int = 3) -> DataFrame:
    """Rows at which the group has failed n times in a row with one of the classes."""
    hit = F.coalesce(F.col(failure).isin(*classes), F.lit(False)).cast("int")
    return rolling(rows, group, order, n, lambda df, w: df.withColumn("_h", F.sum(hit).over(w))).where(F.col("_h") == n).drop("_h")


def trajectory_summary(series: DataFrame, group: str, order: str, score: str, valid: str) -> DataFrame:
    """Final, peak and late stability (1 less the range of the last third) of a run's valid points; 0 where it has none."""
    good = series.where(F.coalesce(F.col(valid), F.lit(False)) & F.col(score).isNotNull())
    w = W.partitionBy(group)
    at = F.row_number().over(w.orderBy(order)) - 1
    tail = F.when(F.col("_i") >= F.floor(F.col("_n") * 2 / 3), F.col(score))
    flat = good.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", at)
    out = flat.groupBy(group).agg(F.max_by(score, order).alias("final"), F.max(score).alias("peak"), (F.max(tail) - F.min(tail)).alias("range"))
    every = series.select(group).distinct().join(out, group, "left")
    return every.select(group, *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("final", "peak")], F.round(F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("range")), F.lit(0.0)), 6).alias("late_stability"))
