"""Work queues: order, matching, leases, candidates not tried yet and generators of new ones. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trialforge.functions.skew import positions


def queue_order(jobs: DataFrame) -> DataFrame:
    """Queued jobs of each resource class in the order in which they are served. Classes are few and large: their jobs are numbered in
    ranges of the order."""
    return positions(jobs.where(F.col("status") == "queued"), ["resource_class"], [F.col(c) for c in ("attempt", "queued_at", "seq")], "place")


def match_workers(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """Idle workers with the jobs they get: the k-th worker of a class takes its k-th job. Jobs beyond the number of workers of
    their class are dropped before the shuffle, as only so many places can be taken."""
    idle = workers.where(F.col("status") == "idle").withColumn("place", F.row_number().over(W.partitionBy("resource_class").orderBy("worker_id")))
    most = idle.agg(F.max("place").alias("m")).first()["m"] or 0
    w = W.partitionBy("resource_class").orderBy("attempt", "queued_at", "seq")
    first = jobs.where(F.col("status") == "queued").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("resource_class", "place", "job_id", "candidate_id")
    return idle.select("worker_id", "resource_class", "place").join(first, ["resource_class", "place"])


def expired_leases(leases: DataFrame, workers: DataFrame, now: Column, default_seconds: int = 1800, whole_seconds: bool = False) -> DataFrame:
    """Leased jobs older than their worker's timeout; a worker that isn't known has the default. Workers are a small table, but
    the optimizer decides how to join them."""
    known = workers.select(F.col("worker_id").alias("_w"), "lease_timeout_seconds")
    both = leases.where(F.col("status") == "leased").join(known, F.col("worker_id") == F.col("_w"), "left").drop("_w")
    age = (F.unix_micros(now) - F.unix_micros("leased_at")) / 1e6
    age = F.floor(age) if whole_seconds else age
    limit = F.coalesce("lease_timeout_seconds", F.lit(default_seconds))
    return both.withColumn("age_seconds", age.cast("double")).where(F.col("age_seconds") > limit)


def untried(options: DataFrame, tried: DataFrame, key: str = "signature") -> DataFrame:
    """Options whose signature has neither been tried nor queued."""
    return options.join(tried.select(key).distinct(), key, "left_anti")


def first_untried(options: DataFrame, tried: DataFrame, group: str, order: list[str], key: str = "signature") -> DataFrame:
    """Each group's first untried option in the configured order."""
    left = untried(options, tried, key)
    rest = [c for c in left.columns if c != group]
    return left.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(group, "_x.*")


def mutations(axes: DataFrame) -> DataFrame:
    """One option for each value of each axis: axis-major, value-minor. axes has family and axes, a list of (path, values)."""
    per_axis = axes.select("family", F.posexplode("axes").alias("axis_pos", "axis"))
    return per_axis.select("family", "axis_pos", F.col("axis.path").alias("path"), F.posexplode("axis.values").alias("value_pos", "value"))


def mutation_parents(families: DataFrame, champions: DataFrame, best: DataFrame, baseline: str) -> DataFrame:
    """family and parent of each family's next mutation: its own champion, else the global one, else the baseline. champions has family
    and champion, best one row with champion."""
    own = families.join(champions, "family", "left")
    top = best.agg(F.max("champion").alias("_best"))
    return own.join(F.broadcast(top), F.lit(True)).select("family", F.coalesce(F.col("champion").cast("string"), F.col("_best").cast("string"), F.lit(baseline)).alias("parent"))


def minted(stable: Column, operator: Column, wins: Column, credits: dict[str, int]) -> Column:
    """The credits that a promotion mints: for itself, a stable score, a new kind of operator and each decisive win."""
    novel = F.coalesce(operator.isin("crossover", "frame_break_spawn"), F.lit(False))
    steady = F.coalesce(stable, F.lit(False))
    return (F.lit(credits["promote_credit"]) + F.when(steady, credits["stable_credit"]).otherwise(0) + F.when(novel, credits["novelty_credit"]).otherwise(0) + wins * credits["prediction_credit"]).cast("long")


def crossovers(champions: DataFrame, compatible: DataFrame) -> DataFrame:
    """For each family the pairs of champions of its compatible families, each pair once, in the order of the list. The pairs come
    from arrays of the configuration; what is joined are families with champions."""
    listed = compatible.select("family", F.posexplode("compatible").alias("pos", "other"))
    own = listed.join(champions.select(F.col("family").alias("_f"), "candidate_id"), F.col("other") == F.col("_f"))
    lists = own.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("pos", "other", "candidate_id"))).alias("l")).where(F.size("l") >= 2)
    left = lists.select("family", "l", F.posexplode("l").alias("i", "a"))
    right = left.select("family", "i", "a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))
    return right.select("family", F.col("a.pos").alias("left_pos"), F.col("b.pos").alias("right_pos"), F.col("a.candidate_id").alias("left_parent"), F.col("b.candidate_id").alias("right_parent"))


def by_precedence(*ranked: tuple[str, DataFrame]) -> DataFrame:
    """Each family's option of the first kind that has one; the frames have family and candidate_id."""
    every = None
    for i, (kind, df) in enumerate(ranked):
        part = df.select("family", F.lit(i).alias("_r"), F.lit(kind).alias("kind"), "candidate_id")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("family").agg(F.min_by(F.struct("kind", "candidate_id"), F.struct("_r", "candidate_id")).alias("x")).select("family", "x.*")


def worker_pool(pools: DataFrame) -> DataFrame:
    """The workers of pools (pos, resource_class, slots, lease_timeout_seconds): ids count from 1; of pools of equal class the last."""
    last = pools.groupBy("resource_class").agg(F.max_by(F.struct("slots", "lease_timeout_seconds"), "pos").alias("p"))
    ids = last.where(F.col("p.slots") >= 1).select("resource_class", F.col("p.lease_timeout_seconds").alias("lease_timeout_seconds"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.slots").cast("long"))).alias("slot"))
    return ids.select(F.concat_ws("-", "resource_class", F.col("slot").cast("string")).alias("worker_id"), "resource_class", F.lit("idle").alias("status"), "lease_timeout_seconds")


def merged_proposals(known: DataFrame, proposals: DataFrame) -> DataFrame:
    """Known families and the approved proposals of families not known, the first of each name; approval is taken for granted
    unless refused."""
    good = proposals.where(~(F.col("approved").eqNullSafe(F.lit(False))) & (F.coalesce("family", F.lit("")) != "") & F.col("body").isNotNull())
    first = good.groupBy("family").agg(F.min_by("body", "seq").alias("body"))
    fresh = first.join(known.select("family"), "family", "left_anti")
    return known.select("family", "body", F.lit(False).alias("added")).unionByName(fresh.select("family", "body", F.lit(True).alias("added")))


def combinations(winners: DataFrame, most: int = 16) -> DataFrame:
    """All subsets of two or more winners (pos, branch), in the order of their bit masks, if there are no more than `most` subsets;
    else all pairs and the whole set, cut to `most`. Winners are a handful: their number is checked before the bits are spread."""
    one = winners.agg(F.array_sort(F.collect_list(F.struct("pos", "branch"))).alias("w")).where(F.size("w") >= 2)
    one = one.select(F.transform("w", lambda x: x["branch"]).alias("w"), F.size("w").alias("n"))
    whole = F.pow(F.lit(2), F.col("n")) <= most
    small = one.where(whole).select("w", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.col("n")).cast("int") - 1)).alias("mask"))
    subset = F.filter("w", lambda b, i: F.expr("shiftright(mask, 0)").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)
    full = small.select(F.col("mask").cast("long").alias("rank"), subset.alias("members")).where(F.size("members") >= 2)
    pairs = one.where(~whole).select("w", "n", F.posexplode("w").alias("i", "a"))
    pairs = pairs.select("w", "n", "i", "a", F.posexplode(F.slice("w", F.col("i") + 2, F.col("n"))).alias("j", "b")).select((F.col("i").cast("long") * F.col("n") + F.col("j")).alias("rank"), F.array("a", "b").alias("members"))
    every = one.where(~whole).select((F.col("n").cast("long") * F.col("n")).alias("rank"), F.col("w").alias("members"))
    out = full.unionByName(pairs).unionByName(every).orderBy("rank").limit(most)
    return out.withColumn("place", F.row_number().over(W.orderBy("rank"))).drop("rank")


def fill_queue(families: DataFrame, open_slots: int, cost: int = 1) -> DataFrame:
    """family and pick, from 1: the families whose options are queued next, as if picked one after the other, where each pick costs
    credits, uses up a probe if there is one, and so lowers the family's priority.

    As a pick only ever lowers its own family's priority, the picks in turn are the best of all (family, k-th pick) by the priority
    that the family has before its k-th pick, earlier families first among equals: one top-k instead of a loop. families has one row
    for each family (family, seq, credits, probes, champion, plateau, options).
    """
    able = F.least(F.floor(F.col("credits") / F.lit(cost)), F.col("options"), F.lit(open_slots)).cast("int")
    picks = families.where((F.col("credits") >= cost) & (F.col("options") > 0)).select("*", F.explode(F.when(able >= 1, F.sequence(F.lit(0), able - 1)).otherwise(F.array().cast("array<int>"))).alias("k"))
    bonus = F.when(F.col("probes") > F.col("k"), 1.0).otherwise(0.0)
    priority = F.col("credits") - F.col("k") * cost + bonus + F.coalesce("champion", F.lit(0.0)) - 0.25 * F.col("plateau")
    order = [F.col("priority").desc(), F.col("seq"), F.col("k")]
    best = picks.withColumn("priority", priority).orderBy(*order).limit(max(open_slots, 0))
    return best.select("family", F.row_number().over(W.orderBy(*order)).cast("long").alias("pick"))
