"""Aggregate diagnostics of an experiment log: costs, failures, efficiency, flat axes, stuck groups, returns and convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trialforge.functions import metrics
from trialforge.operators.latest import last_n

COUNTED = ("PROMOTE", "MARGINAL", "REJECT", "DIAGNOSTIC")
SCORED = ("PROMOTE", "MARGINAL", "REJECT")


def branch_costs(runs: DataFrame) -> DataFrame:
    """Cost and tokens of each branch; the cost of a promotion is null where there is none."""
    cost, promoted = F.coalesce("elapsed_sec", F.lit(0.0)), F.col("verdict") == "PROMOTE"
    out = runs.groupBy("branch").agg(F.sum(cost.cast("decimal(38,6)")).alias("_sum"), F.count(F.lit(1)).alias("n_experiments"), F.count_if(promoted).alias("n_promotions"), F.sum(F.coalesce("tokens_used", F.lit(0))).alias("total_tokens"))
    total = F.col("_sum").cast("double")
    return out.select("branch", F.round(total, 1).alias("total_cost"), F.round(total / F.col("n_experiments"), 1).alias("avg_cost"), F.round(F.try_divide(total, F.col("n_promotions")), 1).alias("cost_per_promote"), "n_experiments", "n_promotions", "total_tokens")


def gate_counts(rejected: DataFrame) -> DataFrame:
    """How often each category of gate failed: every gate of a rejection that lists some, else one told by its reason."""
    listed = F.size(F.coalesce("failures", F.array().cast("array<string>"))) > 0
    gates = F.when(listed, F.transform("failures", metrics.gate_category)).otherwise(F.array(metrics.reject_category(F.coalesce("reason", F.lit("")))))
    return rejected.select(F.explode(gates).alias("gate")).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def binding_gates(rejected: DataFrame, least: int = 10, threshold: float = 0.4) -> DataFrame:
    """Categories that failed in at least `threshold` of the rejections, if there are `least` of them. A rejection with several
    gates counts for each, so a rate may be above 1."""
    # a category a row, and one more for the number of rejections
    total = rejected.agg(F.lit(None).cast("string").alias("gate"), F.count(F.lit(1)).alias("n"))
    both = gate_counts(rejected).unionByName(total).withColumn("total", F.max(F.when(F.col("gate").isNull(), F.col("n"))).over(W.partitionBy(F.lit(0))))
    rate = F.col("n") / F.col("total")
    return both.where(F.col("gate").isNotNull() & (F.col("total") >= least) & (rate >= threshold)).select("gate", "n", F.round(rate, 3).alias("rate"))


def failure_histogram(runs: DataFrame) -> DataFrame:
    """Runs by failure type, in all (branch null) and for each branch: grouping sets over one scan."""
    typed = runs.select("branch", "seq", metrics.failure_type(F.col("verdict"), F.col("failures"), F.coalesce("reason", F.lit(""))).alias("failure_type")).where("failure_type is not null")
    return typed.groupingSets([["failure_type"], ["branch", "failure_type"]], "branch", "failure_type").agg(F.count(F.lit(1)).alias("n"))


def dominant_failure(runs: DataFrame) -> DataFrame:
    """Each branch's commonest failure type; among equals the one seen first."""
    typed = runs.select("branch", "seq", metrics.failure_type(F.col("verdict"), F.col("failures"), F.coalesce("reason", F.lit(""))).alias("t")).where("t is not null")
    counts = typed.groupBy("branch", "t").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return counts.groupBy("branch").agg(F.max_by("t", F.struct("n", -F.col("first"))).alias("failure_type"), F.max("n").alias("n"))


def efficiency_by_branch(runs: DataFrame, branches: DataFrame) -> DataFrame:
    """Counted runs, promotions, first promotion in log order and promotions for each run that the branch has spent."""
    promoted = F.col("verdict") == "PROMOTE"
    per = runs.where(F.col("verdict").isin(*COUNTED)).groupBy("branch").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(promoted).alias("n_promotions"), F.min_by("cycle", F.when(promoted, F.col("seq"))).alias("first_promote_cycle"))
    spent = branches.select(F.col("branch").alias("_b"), "n_experiments")
    out = per.join(spent, F.col("branch") == F.col("_b"), "left")
    roi = F.round(F.col("n_promotions") / F.greatest(F.coalesce("n_experiments", F.lit(0)), F.lit(1)), 3)
    return out.select("branch", "n_runs", "n_promotions", "first_promote_cycle", roi.alias("budget_roi"), (F.col("n_promotions") == 0).alias("never_promoted"))


def efficiency_totals(by_branch: DataFrame) -> DataFrame:
    """Share of runs on branches that never promoted, and totals."""
    out = by_branch.agg(F.sum("n_runs").alias("total_experiments"), F.sum("n_promotions").alias("total_promotions"), F.sum(F.when(F.col("never_promoted"), F.col("n_runs")).otherwise(0)).alias("_w"))
    return out.select("total_experiments", "total_promotions", F.round(F.col("_w") / F.greatest("total_experiments", F.lit(1)), 3).alias("waste_rate"))


def axis_name(delta: Column) -> Column:
    """The axis that a change is on: what stands before the colon, `unknown` for no text."""
    return F.when(F.coalesce(delta, F.lit("")) == "", "unknown").otherwise(F.trim(F.split_part(delta, F.lit(":"), F.lit(1))))


def flat_axes(runs: DataFrame, least_runs: int = 3, epsilon: float = 0.005) -> DataFrame:
    """Axes of branches with enough runs on which at least two scores lie within epsilon."""
    flat = runs.withColumn("axis", axis_name(F.col("delta")))
    per = flat.groupBy("branch", "axis").agg(F.count(F.lit(1)).alias("_rows"), F.count("composite_score").alias("n_scores"), (F.max("composite_score") - F.min("composite_score")).alias("_range"))
    many = per.withColumn("_all", F.sum("_rows").over(W.partitionBy("branch")))
    return many.where((F.col("_all") >= least_runs) & (F.col("n_scores") >= 2) & (F.col("_range") < epsilon)).select("branch", "axis", "n_scores", F.round("_range", 6).alias("score_range"))


def stuck(runs: DataFrame, branches: DataFrame, branch: str = "branch", n: int = 4) -> DataFrame:
    """Branches, not exhausted and with n runs or more, whose last n verdicts hold no promotion."""
    tail = last_n(runs.where(F.col("verdict").isNotNull()).select(branch, "seq", "verdict"), [branch], "seq", n)
    none = tail.groupBy(branch).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("verdict") == "PROMOTE").alias("_p")).where((F.col("_n") >= n) & (F.col("_p") == 0))
    open_ = branches.where((F.col("status") != "exhausted") & (F.col("n_experiments") >= n)).select(branch)
    return none.join(open_, branch, "left_semi").select(branch)


def diminishing(runs: DataFrame, group: list[str], n: int = 8, epsilon: float = 0.005) -> DataFrame:
    """For each group whether its last n scored runs all came within epsilon of the champion; with fewer, not."""
    scored = runs.where(F.col("verdict").isin(*SCORED) & F.col("composite_score").isNotNull() & F.col("champion_score").isNotNull())
    tail = last_n(scored, group, "seq", n)
    near = F.abs(F.col("composite_score") - F.col("champion_score")) < epsilon
    return tail.groupBy(*group).agg(((F.count(F.lit(1)) >= n) & F.every(near)).alias("diminishing"))


def branch_priority(branches: DataFrame, cycle: int) -> DataFrame:
    """Branches that may be explored, ranked: those not visited for ten cycles first, then by expectation, uncertainty and recency."""
    may = branches.where(~F.coalesce(F.col("status").isin("exhausted", "converged"), F.lit(False)) & (F.coalesce("budget", F.lit(0)) > 0))
    since = F.lit(cycle) - F.coalesce("last_explored_cycle", F.lit(0))
    base = 0.3 * F.coalesce("current_ev", F.lit(0.0)) + 0.4 / F.sqrt(1 + F.coalesce("n_experiments", F.lit(0))) + 0.3 * F.least(F.lit(1.0), since / 3.0)
    stale = (since >= 10) & (F.col("status") == "active")
    out = may.withColumn("stale", stale).withColumn("priority", F.when(F.col("stale"), 999.0).otherwise(F.round(base, 6)))
    # one row for each branch
    order = W.orderBy(F.col("stale").desc(), F.when(F.col("stale"), F.col("branch")), F.col("priority").desc(), "n_experiments", F.col("budget").desc(), "branch")
    return out.select("branch", "priority", F.row_number().over(order).alias("place"))


def convergence(runs: DataFrame, branches: DataFrame, cycle: int) -> DataFrame:
    """converged and the reason: the first of open branches, a recent champion and meaningful differences, if any."""
    active = branches.where(~F.coalesce(F.col("status").isin("exhausted", "converged"), F.lit(False)) & (F.coalesce("budget", F.lit(0)) > 0))
    open_ = active.join(stuck(runs, branches), "branch", "left_anti").agg(F.count(F.lit(1)).alias("n_open"))
    last = runs.where(F.col("verdict") == "PROMOTE").agg(F.max("cycle").alias("last_promote"))
    returns = diminishing(runs.withColumn("lab", F.lit(1)), ["lab"])
    # each part is one row
    none = lambda t: F.lit(None).cast(t)
    parts = open_.select("n_open", none("bigint").alias("last_promote"), none("boolean").alias("diminishing"))
    parts = parts.unionByName(last.select(none("bigint").alias("n_open"), "last_promote", none("boolean").alias("diminishing")))
    parts = parts.unionByName(returns.select(none("bigint").alias("n_open"), none("bigint").alias("last_promote"), "diminishing"))
    one = parts.agg(F.max("n_open").alias("n_open"), F.max("last_promote").alias("last_promote"), F.bool_or("diminishing").alias("diminishing"))
    reason = F.when(F.col("n_open") > 0, "active_branches").when(F.lit(cycle) - F.col("last_promote") < 5, "recent_champion").when(~F.coalesce("diminishing", F.lit(False)), "meaningful_deltas").otherwise("converged")
    return one.select((reason == "converged").alias("converged"), reason.alias("reason"), "n_open")
