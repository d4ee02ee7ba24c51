"""Finding hot keys and splitting them, so that no key's rows meet in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from trialforge.functions.lineage import materialize

#: At most so many keys are treated as hot: one that is not among them holds less than 1/MAX_HOT of the rows. With a sketch of TRACKED
#: entries every key above 1/TRACKED*4/3 of the rows is seen.
MAX_HOT, TRACKED = 1024, 8192


def counted_hot_keys(df: DataFrame, key: str, share: float | None = None) -> tuple[int, list]:
    """The number of rows with a key, and the keys that hold about `share` of them or more (default: a quarter of a shuffle
    partition's fair share).

    One pass with a mergeable frequent-items sketch: a bounded answer of MAX_HOT values, whatever the size of df. The keys only
    steer how rows are spread over tasks; no result depends on them. Nulls are never hot.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    share = share or max(1 / (4 * parts), 2 / TRACKED)
    found = df.where(F.col(key).isNotNull()).select(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {MAX_HOT}, {TRACKED})").alias("top")).first()
    least = max(2, found["n"] * share)
    return found["n"], [x["item"] for x in found["top"] or [] if x["count"] >= least]


def hot_keys(df: DataFrame, key: str, share: float | None = None) -> list:
    """The keys that counted_hot_keys finds."""
    return counted_hot_keys(df, key, share)[1]


def is_hot(key: Column, hot: list) -> Column:
    return F.coalesce(key.isin(hot), F.lit(False)) if hot else F.lit(False)


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: list, how: str = "inner", salts: int = 32) -> DataFrame:
    """left joined with right on left_key = right_key, where right has one row per key; right_key is dropped.

    Rows of left under a hot key are spread over `salts` tasks and the right row of that key is sent to each of them; all
    other rows join as they are. Null keys of left match nothing and are spread too.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    k, r = F.col(left_key), F.col(right_key)
    if hot:
        spread = F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith(("map", "variant"))]), F.lit(salts)).cast("int")
        a = left.withColumn("_salt", F.when(is_hot(k, hot) | k.isNull(), spread).otherwise(0))
        b = right.withColumn("_salt", F.explode(F.when(is_hot(r, hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        return a.join(b.withColumnRenamed(right_key, "_right"), (k == F.col("_right")) & (a["_salt"] == b["_salt"]), how).drop("_salt", "_right")
    return left.join(right.withColumnRenamed(right_key, "_right"), k == F.col("_right"), how).drop("_right")


def _between(c: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds are not above c, by halving."""
    if not bounds:
        return F.lit(first)
    k = len(bounds) // 2
    return F.when(c < F.lit(bounds[k]), _between(c, bounds[:k], first)).otherwise(_between(c, bounds[k + 1 :], first + k + 1))


def order_slices(df: DataFrame, group: str, order: str, hot: list, n: int = 128) -> Column:
    """0 for rows of ordinary groups; for hot ones the number of the slice in which the numeric `order` lies. The slices are cut at
    quantiles of the hot groups' rows, so about one in n of these is in each, however their values are spread."""
    if not hot:
        return F.lit(0).cast("long")
    cuts = [k / n for k in range(1, n)]
    bounds = df.where(is_hot(F.col(group), hot)).agg(F.percentile_approx(order, F.array(*[F.lit(c) for c in cuts]), 20 * n).alias("q")).first()["q"]
    inside = _between(F.col(order), sorted(set(bounds or [])))
    return F.when(is_hot(F.col(group), hot) & F.col(order).isNotNull(), inside).otherwise(F.lit(0)).cast("long")


def cut_of(df: DataFrame, group: str, order: str) -> tuple[list, Column]:
    """The hot groups of df and the column of their slices: found once, they serve every running value of the same rows."""
    hot = hot_keys(df, group)
    return hot, order_slices(df, group, order, hot)


def positions(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the place, from 1, of each row in its group by the order columns, which tell all rows of a group apart. Rows are
    range-partitioned on group and order and written, as another run might cut the ranges elsewhere; a row's place is that in its
    range plus the rows of its group in the ranges before. So no task sorts more than its range, however large a group is."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = df.repartitionByRange(parts, *[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id())
    cut, _ = materialize(cut, "ranges")
    counts = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), before.alias("_before"))
    placed = cut.withColumn("_k", F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(counts, same).withColumn(name, (F.col("_before") + F.col("_k")).cast("long")).drop("_range", "_r", "_before", "_k", *[f"_k{i}" for i in range(len(group))])


def rolling(df: DataFrame, group: str, order: str, n: int, add: Callable[[DataFrame, WindowSpec], DataFrame], chunk: int = 50_000) -> DataFrame:
    """add(df, window) with the window of a row and the n - 1 before it in its group by `order`, which is unique there.

    A hot group is cut into chunks of equal size by the places of its rows; each chunk gets the last n - 1 rows of the one before,
    which are dropped after.
    """
    hot, kept = hot_keys(df, group), df.columns
    frame = lambda *keys: W.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    if not hot:
        return add(df, frame(group))
    size = max(chunk, n)
    placed = positions(df.where(is_hot(F.col(group), hot)), [group], [F.col(order)], "_pos")
    own = F.floor((F.col("_pos") - 1) / size)
    tail = F.pmod(F.col("_pos") - 1, F.lit(size)) >= size - (n - 1)
    copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    parts = placed.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    large = add(parts, frame(group, "_chunk")).where("_own = _chunk").drop("_pos", "_own", "_chunk")
    small = add(df.where(~is_hot(F.col(group), hot)).select(kept), frame(group))
    return small.unionByName(large)


def running(df: DataFrame, group: str, order: str, value: Column, how: str, name: str, current: bool = False, ties: tuple[str, ...] = (), cut: tuple[list, Column] | None = None) -> DataFrame:
    """Adds `name`: the max, sum or last non-null of `value` over the group's earlier rows by `order` (numeric; with the columns of
    `ties` unique in a group), with the row itself if `current`; null where there is none.

    Hot groups run in slices of `order`, given by `cut` or found here; what earlier slices add comes from a summary with one row for
    each slice.
    """
    hot, slices = cut or cut_of(df, group, order)
    flat = df.withColumn("_v", value).withColumn("_part", slices)
    w = W.partitionBy(group, "_part").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0 if current else -1)
    fold = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    if not hot:
        return flat.withColumn(name, fold("_v").over(w)).drop("_v", "_part")
    total = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(order, *ties))) if how == "last" else fold("_v")
    parts = flat.where(is_hot(F.col(group), hot)).groupBy(group, "_part").agg(total.alias("_t"))
    above = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), fold("_t").over(above).alias("_before"))
    both = flat.withColumn("_near", fold("_v").over(w)).join(parts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")), "left")
    near, before = F.col("_near"), F.col("_before")
    made = {"max": F.greatest(near, before), "last": F.coalesce(near, before), "sum": F.coalesce(near + before, near, before)}[how]
    return both.withColumn(name, made).drop("_v", "_part", "_near", "_g", "_p", "_before")
