"""Views that map the driver's tables to the engine's inputs. One SQL text each, which Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.functions.skew import running
from trialforge.sources.tables import table

VIEWS = {
    # runs of candidates: a user's events of one day are the attempts of one candidate
    "runs": (
        ("events",),
        """SELECT user_id * 100 + CAST(day(ts) AS BIGINT) AS candidate_id, user_id % 5 AS family, event_id AS seq,
           CAST(row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS BIGINT) AS attempt,
           event_type <> 'error' AS valid, value AS search_eval, value AS selection_eval, props, event_type
           FROM {events}""",
    ),
    # experiments: an order is a run of the branch of its priority
    "experiments": (
        ("orders",),
        """SELECT o_orderkey AS seq, o_orderpriority AS branch, o_custkey AS axis_branch,
           CASE o_orderstatus WHEN 'F' THEN 'REJECT' WHEN 'O' THEN 'PROMOTE' ELSE 'MARGINAL' END AS verdict,
           CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS cycle,
           o_totalprice / 100000.0 AS composite_score,
           CASE WHEN o_orderkey % 4 = 0 THEN concat('lr: ', CAST(o_orderkey % 9 AS VARCHAR(3))) WHEN o_orderkey % 4 = 1 THEN 'depth: +1' WHEN o_orderkey % 4 = 2 THEN 'warm-up' END AS delta,
           CASE WHEN o_orderkey % 5 = 0 THEN 'p_value 0.2' WHEN o_orderkey % 5 = 1 THEN 'Below Baseline' WHEN o_orderkey % 5 = 2 THEN 'score=0.4' ELSE 'late' END AS reason
           FROM {orders}""",
    ),
    # gate failures: up to two texts for each line of an order
    "gates": (
        ("lineitem",),
        """SELECT l_orderkey AS seq, l_linenumber AS pos,
           CASE l_returnflag WHEN 'A' THEN 'p_value 0.31 not significant' WHEN 'N' THEN 'walk-forward window 3 failed' ELSE 'metric 0.41 <= baseline 0.44' END AS gate_text,
           CASE WHEN l_linestatus = 'O' THEN 'causal lag of 2' ELSE 'win rate 0.2' END AS second_text
           FROM {lineitem}""",
    ),
    "costs": (
        ("lineitem", "orders"),
        """SELECT o_orderpriority AS branch, l_quantity AS elapsed_sec, CAST(l_linenumber AS BIGINT) AS tokens_used,
           CASE o_orderstatus WHEN 'F' THEN 'REJECT' WHEN 'O' THEN 'PROMOTE' ELSE 'MARGINAL' END AS verdict
           FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    ),
    "points": (("supplier",), "SELECT s_suppkey AS candidate_id, s_acctbal AS gain, -CAST(s_nationkey AS DOUBLE) AS thrift FROM {supplier}"),
    "jobs": (
        ("orders",),
        """SELECT o_orderkey AS job_id, o_custkey AS candidate_id, o_orderpriority AS resource_class, 1 + o_orderkey % 2 AS attempt,
           o_orderdate AS queued_at, o_orderkey AS seq,
           CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'queued' ELSE 'leased' END AS status, o_orderkey % 40 AS worker_id
           FROM {orders}""",
    ),
    "branches": (
        ("orders",),
        """SELECT o_orderpriority AS branch, count(*) AS n_experiments,
           sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS n_improvements,
           CAST(84 - count(*) % 14 AS BIGINT) AS last_explored_cycle,
           round(avg(o_totalprice) / 300000.0, 3) AS current_ev, 1 + count(*) % 3 AS budget,
           CASE WHEN o_orderpriority LIKE '4%' THEN 'exhausted' ELSE 'active' END AS status
           FROM {orders} GROUP BY o_orderpriority""",
    ),
    "lineage": (("part",), "SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN CAST(floor(p_partkey / 2) AS BIGINT) END AS parent FROM {part}"),
    "series": (("events",), "SELECT user_id AS candidate_id, event_id AS pos, event_id AS step, value / 100.0 AS search_eval, CASE WHEN event_type = 'error' THEN false WHEN event_type = 'view' THEN NULL ELSE true END AS valid FROM {events}"),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The view over the tables of a folder."""
    tables, sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, folder, t) for t in tables})


def scored_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """The experiments with champion_score, their branch's best score so far. Branches are few and large, so it is made in slices."""
    return running(view(spark, folder, "experiments"), "branch", "seq", F.col("composite_score"), "max", "champion_score", current=True)


_SCORED = "SELECT *, max(composite_score) OVER (PARTITION BY branch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS champion_score FROM experiments"


def view_sql(*names: str) -> str:
    """The views as common table expressions for DuckDB; `scored`, which follows experiments, is that of scored_experiments."""
    return ",\n".join(f"{n} AS ({_SCORED if n == 'scored' else VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names)
