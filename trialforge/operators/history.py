"""History of changing attributes: insert-only satellites with hash-diffs, and end dates in lead-based views.

Attributes are split into satellites by how often they change. A satellite holds one row for each change of its attributes and
is only ever appended to; how long a version was valid is a view over it.

Defined results: rows without key or time are left out; of rows with the same key and time the highest `order` counts (equal
`order`: the highest hash-diff); repeated and unchanged rows add nothing; a null attribute is a value of its own; an empty input
gives an empty satellite. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trialforge.functions.skew import hot_keys, is_hot, order_slices


def hash_diff(*attributes: Column) -> Column:
    """One digest of the attributes; null differs from every text."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), a.cast("string")), F.lit("0")) for a in attributes]))


def _neighbour(df: DataFrame, value: str, name: str, ahead: bool, hot: list) -> DataFrame:
    """Adds `name`: `value` (never null) of the key's next row in time, or of the one before; df has key, part and at_us.

    Windows run within (key, part). Only keys with several parts, the hot ones, need the value across a part's border: it comes
    from a summary with one row for each part.
    """
    w = W.partitionBy("key", "part").orderBy("at_us")
    near = (F.lead if ahead else F.lag)(value).over(w)
    if not hot:
        return df.withColumn(name, near)
    pick = F.min_by if ahead else F.max_by
    ends = df.where(is_hot(F.col("key"), hot)).groupBy("key", "part").agg(pick(value, "at_us").alias("_end"))
    order = W.partitionBy("key").orderBy("part")
    ends = ends.select("key", "part", (F.lead if ahead else F.lag)("_end").over(order).alias("_beyond"))
    return df.withColumn("_near", near).join(ends, ["key", "part"], "left").withColumn(name, F.coalesce("_near", "_beyond")).drop("_near", "_beyond")


def satellite(rows: DataFrame, key: Column, at_us: Column, order: Column, attributes: dict[str, Column]) -> tuple[DataFrame, list]:
    """The satellite's rows (key, at_us, hash_diff, attributes) and the keys that were found hot.

    One shuffle brings rows of equal key and time together, after a partial aggregation; one more sorts each key's rows by time.
    A hot key is sorted in slices of time that hold about as many rows each.
    """
    one, hot = _by_time(rows, key, at_us, order, attributes)
    return one.where("starts").select("key", "at_us", "part", "hash_diff", *[F.col("attrs")[n].alias(n) for n in attributes]), hot


def _by_time(rows: DataFrame, key: Column, at_us: Column, order: Column, attributes: dict[str, Column]) -> tuple[DataFrame, list]:
    """One row for each key and time (key, at_us, hash_diff, attrs, part) with `starts`, whether it differs from the one before, and
    the hot keys."""
    flat = rows.select(key.alias("key"), at_us.alias("at_us"), F.coalesce(order, F.lit(-(2**63))).alias("seq"), hash_diff(*attributes.values()).alias("hash_diff"), F.struct(*[c.alias(n) for n, c in attributes.items()]).alias("attrs")).where(F.col("key").isNotNull() & F.col("at_us").isNotNull())
    hot = hot_keys(flat, "key")
    part = order_slices(flat, "key", "at_us", hot)
    one = flat.groupBy("key", "at_us").agg(F.max_by(F.struct("hash_diff", "attrs"), F.struct("seq", "hash_diff")).alias("x"))
    one = one.select("key", "at_us", "x.hash_diff", "x.attrs", part.alias("part"))
    seen = _neighbour(one, "hash_diff", "before", False, hot)
    return seen.withColumn("starts", F.col("before").isNull() | (F.col("before") != F.col("hash_diff"))).drop("before"), hot


def end_dated(sat: DataFrame, hot: list, open_end: int = -1) -> DataFrame:
    """The view of a satellite with the time until which each version was valid; open_end for the last."""
    return _neighbour(sat, "at_us", "until_us", True, hot).withColumn("until_us", F.coalesce("until_us", F.lit(open_end))).drop("part")


def appended(stored: DataFrame, batch: DataFrame, log: DataFrame, key: Column, at_us: Column, order: Column, attributes: dict[str, Column], load: int) -> DataFrame:
    """The rows (key, at_us, hash_diff, load, attributes) that a batch of the log adds to a stored satellite; rows stored are never
    changed. log holds all rows so far, the batch's too: of the keys that the batch touches the versions are made anew, and those are
    added that the store hasn't, so a late row is put in by its time, and a row that it makes differ from the one before comes back.
    Where another row now counts at a time that is stored, that row is added and counts from this load on, see current()."""
    keys = batch.select(key.alias("_k")).where("_k is not null").distinct()
    touched = log.withColumn("_key", key).join(keys, F.col("_key") == F.col("_k"), "left_semi")
    one, _ = _by_time(touched, F.col("_key"), at_us, order, attributes)
    last = current(stored, attributes).select(F.col("key").alias("_k"), F.col("at_us").alias("_at"), F.col("hash_diff").alias("_hash"))
    both = one.join(last, (F.col("key") == F.col("_k")) & (F.col("at_us") == F.col("_at")), "left")
    new = (F.col("starts") & F.col("_hash").isNull()) | (F.col("_hash") != F.col("hash_diff"))
    return both.where(new).select("key", "at_us", "hash_diff", F.lit(load).alias("load"), *[F.col("attrs")[n].alias(n) for n in attributes])


def current(stored: DataFrame, attributes: dict[str, Column]) -> DataFrame:
    """Of a store's rows with equal key and time that of the latest load."""
    rest = F.struct("hash_diff", *attributes)
    return stored.groupBy("key", "at_us").agg(F.max_by(rest, "load").alias("x")).select("key", "at_us", "x.*")


def versions(stored: DataFrame, attributes: dict[str, Column], open_end: int = -1) -> DataFrame:
    """The view of a store that was appended to: its versions with the time until which each was valid. Rows that no longer differ from
    the one before them are no versions."""
    rows = current(stored, attributes)
    sat, hot = satellite(rows, F.col("key"), F.col("at_us"), F.lit(0), {n: F.col(n) for n in attributes})
    return end_dated(sat, hot, open_end)


def change_rates(rows: DataFrame, key: Column, at_us: Column, order: Column, attributes: dict[str, Column]) -> DataFrame:
    """For each attribute how many of the rows that have a row before them differ from it: what the split into satellites rests on."""
    digests = {n: hash_diff(c) for n, c in attributes.items()}
    flat = rows.select(key.alias("key"), at_us.alias("at_us"), order.alias("seq"), F.struct(*[d.alias(n) for n, d in digests.items()]).alias("d")).where(F.col("key").isNotNull() & F.col("at_us").isNotNull())
    hot = hot_keys(flat, "key")
    one = flat.groupBy("key", "at_us").agg(F.max_by("d", F.struct("seq", "d")).alias("d")).withColumn("part", order_slices(flat, "key", "at_us", hot))
    seen = _neighbour(one, "d", "before", False, hot).where(F.col("before").isNotNull())
    counts = seen.agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.col("d")[n] != F.col("before")[n]).alias(n) for n in attributes])
    return counts.select("pairs", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in attributes]), F.array(*[F.col(n) for n in attributes]))).alias("attribute", "changes")).select("attribute", "pairs", "changes")
