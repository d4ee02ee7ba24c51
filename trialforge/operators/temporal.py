"""Time-aware splits and joins: as-of join, purging of overlapping intervals, walk-forward windows and decay.

Null times match nothing. Ties of an as-of join go to the row with the highest tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trialforge.functions.skew import rolling, running


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, tie: str) -> DataFrame:
    """Each left row with the `value` of its key's last right row not after it: a union and a running last value, no join. The rows of
    a hot key are split by time."""
    empty = F.lit(None)
    a = left.select(*left.columns, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), empty.cast("bigint").alias("_tie"), empty.cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.select(*[F.col(key) if c == key else empty.cast(t).alias(c) for c, t in left.dtypes], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("bigint").alias("_tie"), F.col(value).alias("_v"))
    # a null value of the right is a value too: a flag marks that there was a row
    both = a.unionByName(b.where(F.col("_t").isNotNull())).withColumn("_us", F.unix_micros(F.col("_t").cast("timestamp")) if dict(left.dtypes)[left_time].startswith("timestamp") else F.col("_t"))
    out = running(both, key, "_us", F.when(F.col("_side") == 0, F.struct("_v")), "last", "_m", current=True, ties=("_side", "_tie"))
    return out.where("_side = 1").select(*left.columns, F.when(F.col("_t").isNotNull(), F.col("_m._v")).alias(value))


def purged(train: DataFrame, test: DataFrame, start: str, end: str, gap: int, width: int) -> DataFrame:
    """Training rows whose interval overlaps no test interval widened by the gap. Intervals are cut into cells of `width`, so rows
    meet only those of their cells."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    t = test.select(F.col(start).alias("_a"), F.col(end).alias("_b")).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    wide = t.select((F.col("_a") - gap).alias("_a"), (F.col("_b") + gap).alias("_b")).withColumn("_cell", cells(F.col("_a"), F.col("_b")))
    # what the test rows of a cell cover: overlapping ones are merged, so that a row meets few
    w = W.partitionBy("_cell").orderBy("_a", "_b")
    marked = wide.withColumn("_far", F.max("_b").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_new", F.col("_far").isNull() | (F.col("_a") > F.col("_far")))
    merged = marked.withColumn("_run", F.count_if("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("_cell", "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    spread = train.withColumn("_id", F.xxhash64(*train.columns)).withColumn("_cell", cells(F.col(start), F.col(end)))
    hit = spread.join(merged, (spread["_cell"] == merged["_cell"]) & (F.col(start) <= F.col("_b")) & (F.col(end) >= F.col("_a")), "left_semi").select(*train.columns).distinct()
    return train.join(hit, train.columns, "left_anti")


def walk_forward(first: int, last: int, train: int, test: int, step: int, gap: int, spark, expanding: bool = True) -> DataFrame:
    """Windows fold, train_from, train_to, test_from, test_to (ends excluded) with a dead zone of `gap` between the two."""
    folds = max(0, (last - first - train - gap - test) // step + 1)
    k = F.col("id")
    start = F.lit(first) if expanding else first + k * step
    cut = first + train + k * step
    return spark.range(folds).select(k.alias("fold"), start.cast("long").alias("train_from"), cut.alias("train_to"), (cut + gap).alias("test_from"), (cut + gap + test).alias("test_to"))


def walk_forward_scores(rows: DataFrame, time: str, value: str, windows: DataFrame) -> DataFrame:
    """Mean of train and test rows of each fold. Windows are few; a row is sent to those it lies in by their numbers."""
    w = windows.agg(F.array_sort(F.collect_list(F.struct("fold", "train_from", "train_to", "test_from", "test_to"))).alias("w")).first()["w"] or []
    t = F.col(time)
    parts = [F.when((t >= x["train_from"]) & (t < x["train_to"]), F.struct(F.lit(x["fold"]).alias("fold"), F.lit("train").alias("part"))) for x in w]
    parts += [F.when((t >= x["test_from"]) & (t < x["test_to"]), F.struct(F.lit(x["fold"]).alias("fold"), F.lit("test").alias("part"))) for x in w]
    flat = rows.select(F.col(value).alias("v"), F.explode(F.array_compact(F.array(*parts))).alias("p")) if parts else rows.select(F.col(value).alias("v"), F.struct(F.lit(0).cast("long").alias("fold"), F.lit("").alias("part")).alias("p")).where("false")
    return flat.groupBy("p.fold").agg(F.avg(F.when(F.col("p.part") == "train", F.col("v"))).alias("train_mean"), F.avg(F.when(F.col("p.part") == "test", F.col("v"))).alias("test_mean"))


def embargoed(rows: DataFrame, time: str, test_from: int, test_to: int, purge: int, embargo: int) -> DataFrame:
    """Rows with `part`: test within the window, train outside it, and neither (left out) within `purge` before and `embargo` after."""
    t = F.col(time)
    part = F.when((t >= test_from) & (t < test_to), "test").when((t < test_from - purge) | (t >= test_to + embargo), "train")
    return rows.withColumn("part", part).where("part is not null")


def purged_combinations(rows: DataFrame, time: str, value: str, groups: int, k: int, purge: int, embargo: int) -> DataFrame:
    """Every choice of k of `groups` stretches of time as the test: split, test_groups (their numbers), n_train, train_mean, test_mean.
    Training rows within `purge` before or `embargo` after a test stretch are left out.

    Rows are summed up by their time first, so each choice reads the sums of the times, not the rows; choices are few: 2 to the number of
    groups, of which there are 20 at most.
    """
    if not 0 < k < groups <= 20:
        raise ValueError("0 < k < groups <= 20")
    sums = rows.where(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(time).cast("long").alias("t")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    ends = sums.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        return rows.sparkSession.createDataFrame([], "split bigint, test_groups string, n_train bigint, train_mean double, test_mean double")
    first, width = ends["a"], -(-(ends["b"] + 1 - ends["a"]) // groups)
    masks = [m for m in range(1 << groups) if m.bit_count() == k]
    chosen = [(i, ",".join(str(g) for g in range(groups) if m >> g & 1), [g for g in range(groups) if m >> g & 1]) for i, m in enumerate(masks)]
    splits = rows.sparkSession.createDataFrame(chosen, "split bigint, test_groups string, tests array<bigint>")
    both = sums.withColumn("g", F.floor((F.col("t") - first) / width)).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("i"))
    both = both.join(splits, F.col("i") == F.col("split"))
    is_test = F.array_contains("tests", F.col("g"))
    near = F.exists("tests", lambda x: (F.col("t") >= first + x * width - purge) & (F.col("t") < first + (x + 1) * width + embargo))
    both = both.withColumn("part", F.when(is_test, "test").when(~near, "train"))
    total = lambda c, part: F.sum(F.when(F.col("part") == part, F.col(c)))
    out = both.groupBy("split", "test_groups").agg(F.coalesce(total("n", "train"), F.lit(0)).alias("n_train"), (total("s", "train") / total("n", "train")).alias("train_mean"), (total("s", "test") / total("n", "test")).alias("test_mean"))
    return out


def gate(scores: DataFrame, score: Column, least_positive: float = 0.5) -> DataFrame:
    """Share of positive folds, consistency (1 less relative deviation) and whether the share is enough; one row."""
    s = scores.select(score.alias("s")).agg(F.avg(F.when(F.col("s") > 0, 1.0).otherwise(0.0)).alias("positive_share"), (1 - F.try_divide(F.stddev_pop("s"), F.avg("s"))).alias("consistency"))
    return s.withColumn("passed", F.col("positive_share") >= least_positive)


def decay(rows: DataFrame, group: str, order: str, train: Column, test: Column, window: int) -> DataFrame:
    """test/train of each row and its mean over the group's last rows, in five bands."""
    ratios = rows.withColumn("ratio", F.try_divide(test, train))
    out = rolling(ratios, group, order, window, lambda df, w: df.withColumn("rolling_ratio", F.avg("ratio").over(w)))
    r = F.col("rolling_ratio")
    return out.withColumn("band", F.when(r > 1.1, "suspicious").when(r >= 0.9, "healthy").when(r >= 0.7, "moderate").when(r >= 0.5, "concerning").when(r.isNotNull(), "broken"))
