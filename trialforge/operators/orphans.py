"""References to records that do not exist, were deleted before or came only later.

A Bloom filter of all existing keys, broadcast with a fixed bound, proves most orphans at once; more keys than a filter of that
size serves are split into hash ranges with a filter each. Only references that pass are verified by an exact join, which also brings
the times that tell deleted and late records. Repeats are dropped from the orphans found, which are few, not from the references.

Defined results: null and blank references are none; a reference without a time can only be missing, in the period `unknown`;
repeated references count once; without any existing key every reference is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialforge.functions import bloom
from trialforge.functions.lineage import materialize
from trialforge.functions.skew import hot_keys, lookup_join
from trialforge.functions.text import folded, present


def _probed(references: DataFrame, existing: DataFrame, most_bits: int) -> DataFrame:
    """references with `maybe`: false where the filter proves that no key is equal. They are probed as they are read, without a
    shuffle, and written once. Where the keys need more than one filter of most_bits, references are written by hash range first
    and each range is probed with its own filter, one after the other, so that no more than one is held at a time."""
    spark = references.sparkSession
    keys = existing.count()
    ranges, h = bloom.ranges_for(keys, most_bits), F.xxhash64("ref_id")

    def probed(part: DataFrame, own: DataFrame, n: int) -> str:
        shared = spark.sparkContext.broadcast(bloom.build(own, "h", bloom.bits_for(n, most_bits)))
        _, path = materialize(part.withColumn("maybe", bloom.may_contain(shared, h)), "references")
        shared.destroy()
        return path

    if ranges == 1:
        paths = [probed(references, existing, keys)]
    else:
        split, _ = materialize(references.withColumn("_range", bloom.range_of(h, ranges)), "ranges", ["_range"])
        paths = []
        for k in range(ranges):
            own = existing.where(bloom.range_of(F.col("h"), ranges) == k)
            paths.append(probed(split.where(F.col("_range") == k).select(references.columns), own, own.count()))
    return spark.read.schema(references.withColumn("maybe", F.lit(True)).schema).parquet(*paths)


def orphan_references(references: DataFrame, existing: DataFrame, most_bits: int = bloom.MAX_BITS) -> DataFrame:
    """Of references (src, src_key, ref_id, at) those that don't hold, with kind and ref_month, each once; existing has one row for
    each key: id, first_seen, first_removed."""
    existing, _ = materialize(existing.select("id", "first_seen", "first_removed", F.xxhash64("id").alias("h")), "keys")
    references = _probed(references, existing, most_bits)
    sure = references.where(~F.col("maybe")).withColumn("kind", F.lit("missing"))
    doubtful = references.where("maybe")
    joined = lookup_join(doubtful, existing.withColumn("found", F.lit(True)), "ref_id", "id", hot_keys(doubtful, "ref_id"), "left")
    at = F.col("at")
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("first_removed") <= at, "deleted").when(F.col("first_seen") > at, "late")
    checked = joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(sure.columns)
    month = F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))
    return sure.unionByName(checked).select("src", "src_key", "ref_id", "kind", month.alias("ref_month")).distinct()


def _reference(src: str, src_key: Column, ref: Column, at: Column) -> list[Column]:
    return [F.lit(src).alias("src"), src_key.alias("src_key"), folded(ref).alias("ref_id"), at.alias("at")]


def lab_references(candidates: DataFrame, evaluations: DataFrame, workers: DataFrame) -> DataFrame:
    """All references of the lab's tables to candidates, with the time of each."""
    ev = evaluations.where(present("candidate_id")).select(*_reference("evaluations", F.col("attempt").cast("string"), F.col("candidate_id"), F.col("evaluated_at")))
    parents = candidates.select(folded("candidate_id").alias("c"), F.explode("parent_ids").alias("p"), "created_at").where(present("p"))
    ca = parents.select(*_reference("candidates", F.col("c"), F.col("p"), F.col("created_at"))).where(~F.col("src_key").eqNullSafe(F.col("ref_id")))
    slots = workers.select("snapshot_id", F.explode("workers").alias("slot", "w")).where(present(F.col("w.current_candidate_id")))
    wo = slots.select(*_reference("workers", F.concat_ws(":", F.col("snapshot_id").cast("string"), "slot"), F.col("w.current_candidate_id"), F.col("w.leased_at")))
    return ev.unionByName(ca).unionByName(wo)


def lab_existing(candidates: DataFrame, removals: DataFrame) -> DataFrame:
    """Each candidate with the time it was first recorded and first removed; both sides are aggregated before they meet."""
    seen = candidates.where(present("candidate_id")).groupBy(folded("candidate_id").alias("id")).agg(F.min("recorded_at").alias("first_seen"))
    gone = removals.where(present("candidate_id")).groupBy(folded("candidate_id").alias("gone_id")).agg(F.min("removed_at").alias("first_removed"))
    return seen.join(gone, F.col("id") == F.col("gone_id"), "left").drop("gone_id")


def lab_orphans(candidates: DataFrame, evaluations: DataFrame, workers: DataFrame, removals: DataFrame) -> DataFrame:
    return orphan_references(lab_references(candidates, evaluations, workers), lab_existing(candidates, removals))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans for each table, kind and month."""
    return orphans.groupBy("src", "kind", "ref_month").agg(F.count(F.lit(1)).alias("n_orphans"))
