"""One-row summaries of a lab, the phase that follows from them, readiness and health checks, ticks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PENDING = ("queued", "running", "evaluating")
#: Statuses whose candidates take part in Pareto layers.
COMPARED = ("promoted", "evaluating", "rejected", "running", "queued", "invalid")


def pending(latest: DataFrame) -> DataFrame:
    """Candidates that are queued, running or being evaluated."""
    return latest.where(F.col("status").isin(*PENDING))


def queue_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by status, in one row."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return jobs.agg(n("queued"), n("leased"), n("finished"), F.count(F.lit(1)).alias("n_jobs"))


def with_fallback(listed: DataFrame, latest: DataFrame, status: str, suspicion: str) -> DataFrame:
    """The listed candidate ids; if there are none, those whose latest record has the status and suspicion."""
    derived = latest.where((F.col("status") == status) & (F.col("suspicion") == suspicion)).select("candidate_id")
    return listed.select("candidate_id").distinct() if not listed.isEmpty() else derived.distinct()


def phase(ready: Column, initialized: Column, steps: Column, interval: int, expansion: Column, audits: Column, pending_: Column, plateaued: Column) -> Column:
    """What a lab does next: the first of the rules that holds."""
    return (
        F.when(~ready, "design")
        .when(~initialized, "supervisor")
        .when((steps > 0) & (F.pmod(steps, F.lit(interval)) == 0), "checkpoint")
        .when(expansion, "expansion")
        .when(audits > 0, "audit")
        .when(pending_ > 0, "supervisor")
        .when(plateaued, "frame_break")
        .otherwise("supervisor")
    )


def plateaued(flagged: Column, stagnation: Column, window: int) -> Column:
    return F.coalesce(flagged, F.lit(False)) | (F.coalesce(stagnation, F.lit(0)) >= window)


def issues(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, as an array; null counts as failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def health(problems: Column, degraded: Column) -> Column:
    return F.when(degraded, "degraded").when(F.size(problems) > 0, "needs_setup").otherwise("ready")


def ticks(rows: DataFrame, order: str, every: int) -> DataFrame:
    """A snapshot's rows: every n-th step with the totals up to it. The log is one sequence: it is numbered in slices of its order."""
    from trialforge.functions.skew import cut_of, running

    one = rows.withColumn("_lab", F.lit(1))
    cut = cut_of(one, "_lab", order)
    numbered = running(one, "_lab", order, F.lit(1).cast("long"), "sum", "step_count", current=True, cut=cut)
    summed = running(numbered, "_lab", order, F.col("amount").cast("decimal(38,6)"), "sum", "total", current=True, cut=cut)
    return summed.where(F.pmod("step_count", F.lit(every)) == 0).select(order, "step_count", F.col("total").cast("double").alias("total"))


def family_map(families: DataFrame, key: str, value: str) -> DataFrame:
    """One row with the families' values as a map; families are configuration, not data."""
    return families.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("by_family"))


def scout_requests(latest: DataFrame, stuck_families: DataFrame, n: int = 5) -> DataFrame:
    """For each stuck family its last n candidates as one JSON document."""
    w = W.partitionBy("family").orderBy(F.col("seq").desc())
    tail = latest.join(stuck_families.select("family"), "family", "left_semi").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return tail.groupBy("family").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_k", "candidate_id", "status"))), lambda x: F.struct(x["candidate_id"].alias("candidate_id"), x["status"].alias("status")))).alias("recent"))
