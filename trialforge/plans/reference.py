"""Queries over the operators of an experiment log, with their SQL for DuckDB.

Scores that are sums of doubles are rounded on both sides, as their last bits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trialforge.functions import metrics
from trialforge.functions.text import folded, present, sql_folded
from trialforge.operators import configs, detectors, latest, ordered, pareto, queueing, state, temporal
from trialforge.sources.adapters import scored_experiments, view, view_sql
from trialforge.sources.files import overlaid
from trialforge.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(views: tuple[str, ...], rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{view_sql(*views)}{rest}"


# --- latest records and statistics of runs ------------------------------------------------------------------------------


@query("""
SELECT user_id, event_id, event_type AS status, first_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, min(event_id) OVER (PARTITION BY user_id) AS first_seq FROM events)
WHERE n = 1""")
def latest_record(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user."""
    out = latest.latest_record(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "event_id")
    return out.select("user_id", "event_id", F.col("event_type").alias("status"), "first_seq")


_STATS = """,
stats AS (SELECT candidate_id, min(family) AS family, count(*) AS runs, avg(search_eval) AS mean_search, avg(selection_eval) AS mean_selection,
  CASE WHEN count(selection_eval) >= 2 THEN CASE WHEN abs(avg(selection_eval)) > 1e-9 THEN stddev_pop(selection_eval) / abs(avg(selection_eval)) ELSE 0.0 END END AS relative_std,
  bool_and(coalesce(valid, false)) AS all_valid, max(seq) AS last_seq FROM runs GROUP BY candidate_id)"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    runs = view(spark, d, "runs")
    family = F.pmod((F.col("candidate_id") - F.pmod("candidate_id", F.lit(100))) / 100, F.lit(5)).cast("long")
    return latest.run_statistics(runs, "candidate_id", 1.0).withColumn("family", family)


@query(_with(("runs",), _STATS + " SELECT candidate_id, runs, round(mean_search, 6) AS mean_search, round(mean_selection, 6) AS mean_selection, round(relative_std, 6) AS relative_std, coalesce(relative_std <= 1.0, true) AS stable FROM stats"))
def run_mean_relstd(spark: SparkSession, d: str) -> DataFrame:
    """Means, relative deviation and stability of each candidate's attempts."""
    r = lambda c: F.round(c, 6).alias(c)
    return _stats(spark, d).select("candidate_id", "runs", r("mean_search"), r("mean_selection"), r("relative_std"), "stable")


@query(_with(("runs",), _STATS + " SELECT candidate_id, all_valid FROM stats"))
def all_valid_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether every attempt was valid."""
    return _stats(spark, d).select("candidate_id", "all_valid")


@query(_with(("runs",), " SELECT event_type AS test, family, round(avg(search_eval), 6) AS mean_score, arg_min(attempt % 2 = 1, seq) AS decisive FROM runs GROUP BY ALL"))
def prediction_score_mean(spark: SparkSession, d: str) -> DataFrame:
    """E5: mean score of each test of a family, with the flag of its first appearance."""
    runs = view(spark, d, "runs").select("family", F.col("event_type").alias("test"), F.col("search_eval").alias("score"), (F.col("attempt") % 2 == 1).alias("decisive"), "seq")
    return latest.test_means(runs, ["family"], "seq").select("family", "test", F.round("mean_score", 6).alias("mean_score"), "decisive")


# --- metrics ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k, -TRY_CAST(props ->> '$.k' AS DOUBLE) AS k_minimized, CAST(NULL AS DOUBLE) AS absent FROM events")
def metric_lookup_json(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2: a number in JSON, as it is and with less being better."""
    k = metrics.number_at("props", "k")
    return table(spark, d, "events").select("event_id", k.alias("k"), metrics.directed(k, "minimize").alias("k_minimized"), metrics.number_at("props", "k.deeper").alias("absent"))


_BLEND = {"blend": [{"path": "k", "weight": 0.7}, {"path": "gone", "weight": 0.2}, {"path": "k", "weight": 0.3, "direction": "minimize"}]}


@query("""SELECT event_id, round((0.7 * k - 0.3 * k) / 1.0, 6) AS blended, k AS by_path, CAST(NULL AS DOUBLE) AS disabled
FROM (SELECT event_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k FROM events)""")
def blend_score(spark: SparkSession, d: str) -> DataFrame:
    """A weighted mean of the items that are present; a path goes before a blend."""
    s = lambda spec: metrics.scored("props", spec)
    return table(spark, d, "events").select("event_id", F.round(s(_BLEND), 6).alias("blended"), s({"path": "k", **_BLEND}).alias("by_path"), s({"path": "k", "enabled": False}).alias("disabled"))


_TESTS = [{"name": "level", "path": "k", "description": "as measured"}, {"name": "", "path": "k"}, {"name": "thrift", "path": "k", "direction": "minimize", "decisive": False}]


@query("""SELECT event_id, t.name AS test, CASE t.name WHEN 'level' THEN k ELSE -k END AS score, t.name = 'level' AS decisive
FROM (SELECT event_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k FROM events), (VALUES ('level'), ('thrift')) AS t(name)""")
def prediction_test_vector(spark: SparkSession, d: str) -> DataFrame:
    """The named tests of each run, one row each."""
    tests = table(spark, d, "events").select("event_id", F.explode(metrics.prediction_tests("props", _TESTS)).alias("test", "x"))
    return tests.select("event_id", "test", "x.score", "x.decisive")


@query(f"""
SELECT attempt, seq, valid AND error = '' AS valid, search AS search_score, coalesce(selection, search) AS selection_score, CAST(NULL AS DOUBLE) AS final_score FROM (
  SELECT attempt, seq, coalesce(valid, false) AS valid, lower(coalesce(metrics ->> '$.error', '')) AS error,
         TRY_CAST(metrics ->> '$.search.primary_metric' AS DOUBLE) AS search, selection_eval AS selection
  FROM (SELECT attempt, seq, valid, CASE WHEN json_valid(metrics) THEN metrics END AS metrics, CASE WHEN isfinite(selection_eval) THEN selection_eval END AS selection_eval FROM evaluations))""")
def evaluate_result(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a result; the selection score falls back to the search score, an error makes it invalid."""
    ev = table(spark, d, "evaluations")
    search, selection = metrics.scored("metrics", {"path": "search.primary_metric"}), metrics.finite(F.col("selection_eval"))
    valid = F.coalesce("valid", F.lit(False)) & (metrics.error_text("metrics") == "")
    return ev.select("attempt", "seq", valid.alias("valid"), search.alias("search_score"), F.coalesce(selection, search).alias("selection_score"), metrics.scored("metrics", {"path": "final.primary_metric", "enabled": False}).alias("final_score"))


def _like(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_ERROR_CASES = " ".join(f"WHEN {_like('e', words)} THEN '{name}'" for name, words in metrics.ERROR_RULES)


@query(f"""
SELECT seq, attempt, CASE WHEN lower(failure_class) IN ('nan', 'oom', 'arch', 'data', 'unstable', 'overfit', 'other') THEN lower(failure_class) {_ERROR_CASES}
  WHEN NOT coalesce(valid, false) THEN 'other' WHEN s - h > 0.18 THEN 'overfit' END AS failure_class
FROM (SELECT seq, attempt, failure_class, valid, lower(coalesce(m ->> '$.error', '')) AS e, TRY_CAST(m ->> '$.search.primary_metric' AS DOUBLE) AS s,
        TRY_CAST(m ->> '$.challenges.holdout_generalization.primary_metric' AS DOUBLE) AS h
      FROM (SELECT *, CASE WHEN json_valid(metrics) THEN metrics END AS m FROM evaluations))""")
def failure_class(spark: SparkSession, d: str) -> DataFrame:
    """The class of a failure: given, or told by error text, flag and gap."""
    ev = table(spark, d, "evaluations")
    return ev.select("seq", "attempt", metrics.failure_class(F.col("failure_class"), F.col("valid"), "metrics", F.lit(None).cast("string")).alias("failure_class"))


_GATE_CASE = f"""CASE WHEN {_like('s', metrics.SIGNIFICANCE)} THEN 'significance'
  WHEN contains(s, 'baseline') OR (contains(s, 'metric') AND contains(s, '<=')) THEN 'below_baseline'
  WHEN {_like('s', metrics.WALK_FORWARD)} THEN 'walk_forward' WHEN {_like('s', metrics.COLLAPSED)} THEN 'model_collapsed'
  WHEN {_like('s', metrics.CAUSALITY)} THEN 'causality' WHEN {_like('s', metrics.WIN_RATE)} THEN 'win_rate' ELSE 'other' END"""
_REASON_CASE = "CASE WHEN contains(reason, 'p_value') OR contains(reason, 'p=') THEN 'significance' WHEN contains(lower(reason), 'baseline') OR contains(lower(reason), 'metric') THEN 'below_baseline' WHEN contains(reason, 'score=') THEN 'soft_below_champion' ELSE 'other' END"


@query(_with(("gates",), f" SELECT seq, CAST(pos AS BIGINT) AS pos, {_GATE_CASE} AS category FROM (SELECT seq, pos, lower(gate_text) AS s FROM gates)"))
def gate_class(spark: SparkSession, d: str) -> DataFrame:
    """The category of each gate's failure text."""
    return view(spark, d, "gates").select("seq", F.col("pos").cast("long").alias("pos"), metrics.gate_category(F.col("gate_text")).alias("category"))


_SPECS = [{"path": "k", "label": "k"}, {"path": "gone", "label": "gone", "direction": "minimize"}, {"path": "k", "direction": "minimize", "label": "k"}]


@query("SELECT event_id, CAST(1 AS BIGINT) AS n_missing, k AS k_restored, -k AS last_objective FROM (SELECT event_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k FROM events)")
def objective_vector(spark: SparkSession, d: str) -> DataFrame:
    """Objectives as a vector, the labels restored (of equal ones the last), and how many are missing."""
    v = metrics.objective_vector("props", _SPECS)
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", metrics.missing_objectives(F.col("v")).alias("n_missing"), metrics.labelled(F.col("v"), _SPECS)["k"].alias("k_restored"), F.col("v")[2].alias("last_objective"))


@query("""SELECT p_partkey AS part, substr(sha1('{"config_patch": {"n": ' || p_size || '}, "family": "' || p_brand || '", "operator_type": "probe", "parent_ids": ["a", "b"]}'), 1, 12) AS signature,
 p_brand || '_probe_' || substr(sha1('{"config_patch": {"n": ' || p_size || '}, "family": "' || p_brand || '", "operator_type": "probe", "parent_ids": ["a", "b"]}'), 1, 12) AS candidate_id FROM part""")
def signature(spark: SparkSession, d: str) -> DataFrame:
    """Signature and id of a candidate; parents are sorted before they are signed."""
    sign = configs.signature(F.col("p_brand"), F.lit("probe"), F.format_string('{"n": %d}', "p_size"), F.array(F.lit("b"), F.lit("a")))
    out = table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_brand", sign.alias("signature"))
    return out.select("part", "signature", configs.candidate_id(F.col("p_brand"), F.lit("probe"), F.col("signature")).alias("candidate_id"))


@query("""SELECT p_partkey AS part, '{"model": {"depth": ' || p_size || ', "type": "' || p_brand || '"}, "seed": null}' AS merged, '{"model": {"depth": ' || p_size || '}}' AS patch FROM part""")
def deep_merge(spark: SparkSession, d: str) -> DataFrame:
    """A patch made from a path and merged over a configuration; null replaces."""
    part = table(spark, d, "part")
    patch = configs.nested_patch(F.lit("model.depth"), F.col("p_size").cast("string"))
    base = F.format_string('{"model": {"depth": 1, "type": "%s"}, "seed": 7}', "p_brand")
    return part.select(F.col("p_partkey").alias("part"), configs.deep_merge_all(F.array(base, patch, F.lit('{"seed": null}'))).alias("merged"), patch.alias("patch"))


@query("SELECT event_id, epoch_us(ts) AS parsed_us, epoch_us(ts) - 7200000000 AS with_offset_us, CAST(NULL AS BIGINT) AS bad_us FROM events")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    """ISO-8601 texts with and without an offset."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, d, "events").select("event_id", metrics.iso_micros(F.concat(text, F.lit("Z"))).alias("parsed_us"), metrics.iso_micros(F.concat(text, F.lit("+02:00"))).alias("with_offset_us"), metrics.iso_micros(F.concat(F.lit("x"), text)).alias("bad_us"))


@query(_with(("branches",), " SELECT branch, CASE WHEN status = 'converged' THEN '=' WHEN status = 'exhausted' THEN 'x' WHEN n_experiments = 0 THEN '.' WHEN n_improvements > 0 THEN '+' ELSE '-' END AS icon FROM branches"))
def status_icon(spark: SparkSession, d: str) -> DataFrame:
    """One character for the state of each branch."""
    return view(spark, d, "branches").select("branch", metrics.status_icon(F.col("status"), F.col("n_improvements"), F.col("n_experiments")).alias("icon"))


@query("SELECT p_partkey AS part, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 'pyyaml' ELSE 'pkg-' || p_size END AS package, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 'yaml' ELSE 'pkg_' || p_size END AS import_name FROM part")
def requirement_names(spark: SparkSession, d: str) -> DataFrame:
    """The package that a line of a requirements file names, and the name it is imported under."""
    line = F.element_at(F.array(F.lit("git+https://example.org/x"), F.format_string("PKG-%d[extra]>=1.0 ; python_version > '3' # pinned", "p_size"), F.format_string(" pkg-%d==2", "p_size"), F.lit("PyYAML>=6")), (F.col("p_partkey") % 4 + 1).cast("int"))
    package = metrics.requirement_name(line)
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), package.alias("package"), metrics.import_name(package).alias("import_name"))


@query("""SELECT p_partkey AS part, round(exp(-power(p_size - 4, 2) / 8.0), 9) AS bell, round(exp(-power(ln(p_retailprice) - ln(1200.0), 2) / 0.5), 9) AS log_bell,
  greatest(0.0, least(1.0, p_size / 40.0)) AS clamped, CAST(2 * 96 * p_size + 32 * p_size + (p_partkey % 7) * (12 * p_size * p_size + 4 * p_size) AS BIGINT) AS n_parameters FROM part""")
def shaped_scores(spark: SparkSession, d: str) -> DataFrame:
    """Bell-shaped and clamped scores, and the size of a model."""
    part = table(spark, d, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return part.select(F.col("p_partkey").alias("part"), F.round(metrics.gaussian(size, 4.0, 2.0), 9).alias("bell"), F.round(metrics.log_normal(price, 1200.0, 0.5), 9).alias("log_bell"), metrics.clamped(size / 40.0).alias("clamped"), metrics.parameter_count(F.col("p_partkey") % 7, F.col("p_size").cast("long"), F.lit(32)).alias("n_parameters"))


@query(_with(("runs",), " SELECT candidate_id, attempt, 'candidate ' || candidate_id || ' attempt ' || attempt || ' is ' || CASE WHEN valid THEN 'valid' ELSE 'invalid' END AS line FROM runs"))
def findings_text(spark: SparkSession, d: str) -> DataFrame:
    """Log lines from a template."""
    return view(spark, d, "runs").select("candidate_id", "attempt", F.format_string("candidate %d attempt %d is %s", "candidate_id", "attempt", F.when(F.col("valid"), "valid").otherwise("invalid")).alias("line"))


@query(_with(("series",), """ SELECT candidate_id, coalesce(v, true) AS valid, CASE WHEN NOT coalesce(v, true) THEN CASE WHEN loss IS NULL THEN 'nan' ELSE 'unstable' END END AS failure_class
FROM (SELECT candidate_id, last(valid ORDER BY pos) AS v, CASE WHEN max(pos) % 2 = 0 THEN NULL ELSE 1.0 END AS loss FROM series GROUP BY candidate_id)"""))
def run_outcome(spark: SparkSession, d: str) -> DataFrame:
    """How a run ended, told by its last point."""
    last = view(spark, d, "series").groupBy("candidate_id").agg(F.max_by(F.struct("valid", F.when(F.col("pos") % 2 == 1, 1.0).alias("loss")), "pos").alias("x"))
    ok = F.coalesce("x.valid", F.lit(True))
    return last.select("candidate_id", ok.alias("valid"), F.when(~ok, F.when(F.col("x.loss").isNull() | F.isnan("x.loss"), "nan").otherwise("unstable")).alias("failure_class"))


@query(_with(("runs",), """ SELECT family, round(0.40 * avg(search_eval) + 0.25 * max(search_eval) + 0.15 * min(search_eval) + 0.10 * count(*) / 100.0 + 0.10 * avg(attempt) - 0.05 * max(attempt), 6) AS composite FROM runs GROUP BY family"""))
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """A weighted sum of components less a penalty."""
    s = F.col("search_eval")
    parts = [(0.40, F.avg(s)), (0.25, F.max(s)), (0.15, F.min(s)), (0.10, F.count(F.lit(1)) / 100.0), (0.10, F.avg("attempt"))]
    total = sum((w * c for w, c in parts), F.lit(0.0)) - 0.05 * F.max("attempt")
    return view(spark, d, "runs").groupBy("family").agg(F.round(total, 6).alias("composite"))


# --- order --------------------------------------------------------------------------------------------------------------


@query(_with(("series",), """,
p AS (SELECT *, coalesce(valid, false) AND search_eval IS NOT NULL AS good, count(*) OVER g AS n, row_number() OVER o - 1 AS i FROM series WINDOW g AS (PARTITION BY candidate_id), o AS (PARTITION BY candidate_id ORDER BY pos)),
q AS (SELECT *, count(*) FILTER (WHERE good) OVER (PARTITION BY candidate_id) AS gn, count(*) FILTER (WHERE good) OVER (PARTITION BY candidate_id ORDER BY pos) AS gi FROM p),
r AS (SELECT candidate_id, count(*) AS checkpoints, count(*) FILTER (WHERE good) AS valid_checkpoints,
  avg(search_eval) FILTER (WHERE good AND gi <= greatest(1, gn // 3)) AS f, avg(search_eval) FILTER (WHERE good AND gi > gn - greatest(1, gn // 3)) AS l,
  count(*) FILTER (WHERE valid = false) > 0 AS bad, count(*) FILTER (WHERE valid = false AND i >= n // 2) > 0 AS tail, arg_max(step, pos) AS last_step FROM q GROUP BY candidate_id)
SELECT candidate_id, checkpoints, valid_checkpoints, round(f, 6) AS first_mean, round(l, 6) AS last_mean, round(l - f, 6) AS delta,
  CASE WHEN valid_checkpoints = 0 THEN CASE WHEN bad THEN 'collapsed' ELSE 'no_signal' END WHEN tail THEN 'collapsed' WHEN l - f > 0.02 THEN 'improving' WHEN l - f < -0.02 THEN 'regressing' ELSE 'plateau' END AS trend, last_step FROM r"""))
def checkpoint_trend(spark: SparkSession, d: str) -> DataFrame:
    """the trend of each run by thirds of its valid points."""
    return ordered.thirds_trend(view(spark, d, "series"), "candidate_id", "pos", "search_eval", "valid", "step")


@query(_with(("series",), """,
p AS (SELECT candidate_id, pos, search_eval AS s, row_number() OVER (PARTITION BY candidate_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY candidate_id) AS n FROM series WHERE valid)
SELECT candidate_id, round(coalesce(f, 0.0), 6) AS final, round(coalesce(m, 0.0), 6) AS peak, round(coalesce(greatest(0.0, 1 - r), 0.0), 6) AS late_stability
FROM (SELECT DISTINCT candidate_id FROM series) LEFT JOIN (
  SELECT candidate_id, arg_max(s, pos) AS f, max(s) AS m, max(s) FILTER (WHERE i >= n * 2 // 3) - min(s) FILTER (WHERE i >= n * 2 // 3) AS r FROM p GROUP BY candidate_id) USING (candidate_id)"""))
def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    """Final, peak and late stability of each run."""
    return ordered.trajectory_summary(view(spark, d, "series"), "candidate_id", "pos", "search_eval", "valid")


@query(_with(("runs",), """,
p AS (SELECT family, event_type AS test, seq, search_eval AS score, max(search_eval) OVER (PARTITION BY family, event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM runs WHERE event_type <> 'view')
SELECT family, test, seq, score, bar FROM p WHERE bar IS NULL OR score > bar"""))
def decisive_leaders(spark: SparkSession, d: str) -> DataFrame:
    """candidates that beat all before them in a decisive test; ties keep the incumbent."""
    runs = view(spark, d, "runs").where("event_type <> 'view'").select("family", F.col("event_type").alias("test"), "seq", F.col("search_eval").alias("score"), F.concat_ws(":", "family", "event_type").alias("g"))
    return ordered.prefix_leaders(runs, "g", "seq", F.col("score")).select("family", "test", "seq", "score", "bar")


@query(_with(("runs",), """,
n AS (SELECT family, seq, search_eval - 50.0 AS s, row_number() OVER (PARTITION BY family ORDER BY seq) AS k FROM (SELECT family, seq, round(search_eval) AS search_eval FROM runs WHERE event_type = 'purchase')),
f AS (
  SELECT family, k, seq, s, true AS led, s AS leader FROM n WHERE k = 1
  UNION ALL SELECT n.family, n.k, n.seq, n.s, f.leader = 0 OR n.s > f.leader, CASE WHEN f.leader = 0 OR n.s > f.leader THEN n.s ELSE f.leader END FROM f JOIN n ON n.family = f.family AND n.k = f.k + 1)
SELECT family, seq, s AS score FROM f WHERE led""", True))
def zero_is_missing_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Leaders where a leader of exactly 0 counts as none, so that any score follows it."""
    runs = view(spark, d, "runs").where("event_type = 'purchase'").select("family", "seq", (F.round("search_eval") - 50.0).alias("score"))
    return ordered.prefix_leaders(runs, "family", "seq", F.col("score"), zero_is_missing=True).select("family", "seq", "score")


_FOLD = _STATS + """,
agg AS (SELECT *, all_valid AND runs >= 2 AND coalesce(relative_std <= 1.0, true) AS eligible, row_number() OVER (PARTITION BY family ORDER BY last_seq) AS k FROM stats),
fold AS (
  SELECT family, k, candidate_id, CAST(NULL AS DOUBLE) AS champion_before, CASE WHEN eligible THEN mean_selection END AS champion FROM agg WHERE k = 1
  UNION ALL
  SELECT a.family, a.k, a.candidate_id, f.champion, CASE WHEN a.eligible AND (f.champion IS NULL OR a.mean_selection > f.champion + 1.0) THEN a.mean_selection ELSE f.champion END
  FROM fold f JOIN agg a ON a.family = f.family AND a.k = f.k + 1)"""


def _folded_runs(spark: SparkSession, d: str) -> DataFrame:
    eligible = F.col("all_valid") & (F.col("runs") >= 2) & F.col("stable")
    return ordered.champion_fold(_stats(spark, d), "family", "last_seq", "mean_selection", eligible, 1.0)


@query(_with(("runs",), _FOLD + " SELECT candidate_id, round(champion_before, 6) AS champion_before FROM fold", True))
def champion_fold(spark: SparkSession, d: str) -> DataFrame:
    """the champion that each candidate met, with a margin that must be passed."""
    return _folded_runs(spark, d).select("candidate_id", F.round("champion_before", 6).alias("champion_before"))


@query(_with(("runs",), _FOLD + """
SELECT candidate_id, CASE WHEN p AND runs < 2 THEN 'evaluating' WHEN NOT all_valid AND mean_search > coalesce(c, -1e300) + 1.0 THEN 'invalidated'
  WHEN p AND s THEN 'promoted' ELSE 'rejected' END AS decision
FROM (SELECT *, all_valid AND (f.champion_before IS NULL OR mean_selection > f.champion_before + 1.0) AS p, coalesce(relative_std <= 1.0, true) AS s, f.champion_before AS c FROM agg JOIN fold f USING (candidate_id))""", True))
def promotion_decision(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each candidate, given the champion that it met."""
    c = F.col("champion_before")
    better = F.col("all_valid") & (c.isNull() | (F.col("mean_selection") > c + 1.0))
    fast = ~F.col("all_valid") & (F.col("mean_search") > F.coalesce(c, F.lit(-1e300)) + 1.0)
    decision = F.when(better & (F.col("runs") < 2), "evaluating").when(fast, "invalidated").when(better & F.col("stable"), "promoted").otherwise("rejected")
    return _folded_runs(spark, d).select("candidate_id", decision.alias("decision"))


@query(_with(("runs",), """,
p AS (SELECT seq, search_eval, max(search_eval) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM runs WHERE event_type = 'purchase')
SELECT seq, search_eval AS score FROM p WHERE bar IS NULL OR search_eval > bar"""))
def global_champion(spark: SparkSession, d: str) -> DataFrame:
    """the champions over all families, one after the other."""
    won = view(spark, d, "runs").where("event_type = 'purchase'").select(F.lit("lab").alias("lab"), "seq", F.col("search_eval").alias("score"))
    return ordered.prefix_leaders(won, "lab", "seq", F.col("score")).select("seq", "score")


@query(_with(("runs",), """,
p AS (SELECT family, seq, event_type = 'purchase' AS promoted, event_type IN ('error', 'click') AS rejected, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY family ORDER BY seq) AS island FROM runs)
SELECT family, seq, count(*) FILTER (WHERE rejected) OVER (PARTITION BY family, island ORDER BY seq) AS plateau FROM p"""))
def plateau_counter(spark: SparkSession, d: str) -> DataFrame:
    """rejections since the last promotion; other outcomes leave the count as it is."""
    e = F.col("event_type")
    return ordered.plateau_counter(view(spark, d, "runs"), "family", "seq", e == "purchase", e.isin("error", "click")).select("family", "seq", "plateau")


_AMOUNT = "CASE event_type WHEN 'purchase' THEN 4 WHEN 'view' THEN 0 ELSE -1 END"


@query(_with(("runs",), f" SELECT family, seq, CAST({_AMOUNT} AS BIGINT) AS amount, CAST(10 + sum({_AMOUNT}) OVER (PARTITION BY family ORDER BY seq) AS BIGINT) AS balance FROM runs"))
def credit_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of credits, with the balance after each entry."""
    amount = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "view", 0).otherwise(-1).cast("long")
    runs = view(spark, d, "runs").select("family", "seq", amount.alias("amount"))
    return ordered.ledger(runs, "family", "seq", F.col("amount"), 10)


@query(_with(("runs",), " SELECT family, least(30, 5 + CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 400 THEN 3 ELSE 0 END + min(candidate_id) % 30) AS credits FROM runs GROUP BY family"))
def budget_replenishment(spark: SparkSession, d: str) -> DataFrame:
    """A fixed amount, more for productive families, up to a cap."""
    more = F.when(F.count_if(F.col("event_type") == "purchase") > 400, 3).otherwise(0)
    return view(spark, d, "runs").groupBy("family").agg(F.least(F.lit(30).cast("long"), (5 + more + F.min("candidate_id") % 30).cast("long")).alias("credits"))


@query(_with(("experiments",), " SELECT axis_branch, seq, CAST(place AS INTEGER) AS place FROM (SELECT axis_branch, seq, row_number() OVER (PARTITION BY axis_branch ORDER BY seq DESC) AS place FROM experiments) WHERE place <= 5"))
def last_five(spark: SparkSession, d: str) -> DataFrame:
    """the last five runs of each group."""
    return latest.last_n(view(spark, d, "experiments"), ["axis_branch"], "seq", 5).select("axis_branch", "seq", "place")


@query(_with(("experiments", "scored"), """,
p AS (SELECT axis_branch, composite_score, champion_score, row_number() OVER (PARTITION BY axis_branch ORDER BY seq DESC) AS n FROM scored WHERE verdict IN ('PROMOTE', 'MARGINAL', 'REJECT'))
SELECT axis_branch, count(*) >= 8 AND bool_and(abs(composite_score - champion_score) < 2.5) AS diminishing FROM p WHERE n <= 8 GROUP BY axis_branch"""))
def diminishing_returns(spark: SparkSession, d: str) -> DataFrame:
    """whether the last eight scored runs all came close to the champion."""
    return detectors.diminishing(scored_experiments(spark, d), ["axis_branch"], 8, 2.5)


@query(_with(("experiments",), """,
p AS (SELECT axis_branch, verdict, row_number() OVER (PARTITION BY axis_branch ORDER BY seq DESC) AS n FROM experiments)
SELECT axis_branch FROM p WHERE n <= 4 GROUP BY axis_branch HAVING count(*) >= 4 AND count(*) FILTER (WHERE verdict = 'PROMOTE') = 0"""))
def stuck_branches(spark: SparkSession, d: str) -> DataFrame:
    """F8: branches whose last four runs hold no promotion."""
    runs = view(spark, d, "experiments")
    counts = runs.groupBy("axis_branch").agg(F.count(F.lit(1)).alias("n_experiments"), F.lit("active").alias("status"))
    return detectors.stuck(runs, counts, "axis_branch")


@query(_with(("runs",), """,
p AS (SELECT seq, family, search_eval AS s, count(search_eval) OVER w AS n, avg(search_eval) OVER w AS m, stddev_samp(search_eval) OVER w AS v FROM runs WINDOW w AS (PARTITION BY family ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT seq, round(CASE WHEN n >= 5 AND v >= 0.001 THEN abs(s - m) / v END, 6) AS z_score, coalesce(n >= 5 AND v >= 0.001 AND abs(s - m) / v > 3.0, false) AS surprising FROM p"""))
def surprise_zscore(spark: SparkSession, d: str) -> DataFrame:
    """scores far from those of the last twenty runs."""
    return ordered.z_scores(view(spark, d, "runs"), "family", "seq", "search_eval").select("seq", F.round("z_score", 6).alias("z_score"), "surprising")


@query(_with(("runs",), """,
p AS (SELECT family, seq, count(*) FILTER (WHERE event_type IN ('error', 'click')) OVER (PARTITION BY family ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h FROM runs)
SELECT family, seq FROM p WHERE h = 3"""))
def repeat_failure(spark: SparkSession, d: str) -> DataFrame:
    """groups that failed three times in a row."""
    return ordered.repeated_failures(view(spark, d, "runs"), "family", "seq", "event_type", ["error", "click"]).select("family", "seq")


# --- archives and top lists ---------------------------------------------------------------------------------------------


@query(_with(("runs",), " SELECT candidate_id, seq, CAST(place AS INTEGER) AS place FROM (SELECT candidate_id, seq, row_number() OVER (ORDER BY nullif(selection_eval, 0) DESC NULLS LAST, seq) AS place FROM runs WHERE valid) WHERE place <= 20"))
def elite_archive_global(spark: SparkSession, d: str) -> DataFrame:
    """G1: the twenty best promotions; a score of 0 sorts as none."""
    good = view(spark, d, "runs").where("valid")
    return latest.best_overall(good, F.nullif("selection_eval", F.lit(0.0)), "seq", 20).select("candidate_id", "seq", "place")


@query(_with(("runs",), " SELECT family, candidate_id, seq, CAST(place AS INTEGER) AS place FROM (SELECT family, candidate_id, seq, row_number() OVER (PARTITION BY family ORDER BY nullif(selection_eval, 0) DESC NULLS LAST, seq) AS place FROM runs WHERE valid) WHERE place <= 3"))
def elite_archive_family(spark: SparkSession, d: str) -> DataFrame:
    """G1: the three best promotions of each family."""
    good = view(spark, d, "runs").where("valid")
    return latest.best_n(good, ["family"], F.nullif("selection_eval", F.lit(0.0)), "seq", 3).select("family", "candidate_id", "seq", "place")


@query(_with(("runs",), _STATS + " SELECT candidate_id, round(mean_selection, 6) AS mean_selection, CAST(row_number() OVER (ORDER BY coalesce(mean_selection, -999) DESC, candidate_id) AS INTEGER) AS place FROM stats WHERE all_valid ORDER BY place LIMIT 12"))
def frontier_top12(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best candidates by their latest records; a missing score counts as -999."""
    best = latest.best_overall(_stats(spark, d).where("all_valid"), F.coalesce("mean_selection", F.lit(-999.0)), "candidate_id", 12)
    return best.select("candidate_id", F.round("mean_selection", 6).alias("mean_selection"), "place")


@query("""SELECT event_id, event_type, CAST(k IS NOT NULL AS BIGINT) AS n_scores FROM (SELECT event_id, event_type, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k FROM events) ORDER BY event_id DESC LIMIT 12""")
def recent_evals(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve evaluations with how many of their challenges have a score."""
    last = table(spark, d, "events").orderBy(F.col("event_id").desc()).limit(12)
    tests = metrics.prediction_tests("props", [{"name": "level", "path": "k"}, {"name": "gone", "path": "gone"}])
    n = F.size(F.filter(F.map_values(tests), lambda x: x["score"].isNotNull())).cast("long")
    return last.select("event_id", "event_type", n.alias("n_scores"))


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events ORDER BY event_id DESC LIMIT 10) GROUP BY event_type")
def synthesis(spark: SparkSession, d: str) -> DataFrame:
    """How the last ten evaluations are spread over classes."""
    return table(spark, d, "events").orderBy(F.col("event_id").desc()).limit(10).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# --- filters, sets and joins --------------------------------------------------------------------------------------------

_CURRENT = f"""
cur AS (SELECT * FROM (SELECT {sql_folded('candidate_id')} AS id, {sql_folded('family')} AS fam, {sql_folded('status')} AS st, suspicion, seq,
  row_number() OVER (PARTITION BY {sql_folded('candidate_id')} ORDER BY seq DESC) AS n FROM candidates WHERE coalesce({sql_folded('candidate_id')}, '') <> '') WHERE n = 1)"""


def _current(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").where(present("candidate_id"))
    best = c.groupBy(folded("candidate_id").alias("candidate_id")).agg(F.max_by(F.struct(folded("family").alias("family"), folded("status").alias("status"), "suspicion", "seq"), "seq").alias("x"))
    return best.select("candidate_id", "x.*")


@query(f"WITH {_CURRENT} SELECT id AS candidate_id, st AS status FROM cur WHERE st IN ('queued', 'running', 'evaluating')")
def pending_filter(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose latest record is pending."""
    return state.pending(_current(spark, d)).select("candidate_id", "status")


@query(f"""WITH {_CURRENT}, listed AS (SELECT DISTINCT {sql_folded('u')} AS id FROM (SELECT unnest(invalid_fast_candidates) AS u FROM frontier) WHERE coalesce({sql_folded('u')}, '') <> '')
SELECT id AS candidate_id FROM listed UNION SELECT id FROM cur WHERE st = 'invalidated' AND suspicion = 'invalid_fast' AND NOT EXISTS (SELECT 1 FROM listed)""")
def invalid_fast(spark: SparkSession, d: str) -> DataFrame:
    """The listed candidates, or, if none are listed, those whose record says so."""
    listed = table(spark, d, "frontier").select(F.explode("invalid_fast_candidates").alias("c")).where(present("c")).select(folded("c").alias("candidate_id"))
    return state.with_fallback(listed, _current(spark, d), "invalidated", "invalid_fast")


@query(f"""WITH {_CURRENT}, ev AS (SELECT * FROM (SELECT {sql_folded('candidate_id')} AS cid, attempt, row_number() OVER (PARTITION BY {sql_folded('candidate_id')} ORDER BY seq DESC) AS n
  FROM evaluations WHERE coalesce({sql_folded('candidate_id')}, '') <> '') WHERE n = 1)
SELECT cid AS candidate_id, attempt, st AS status, st IN ('promoted', 'evaluating', 'rejected', 'running', 'queued', 'invalid') AS compared FROM ev LEFT JOIN cur ON cid = id""")
def latest_join(spark: SparkSession, d: str) -> DataFrame:
    """The latest evaluation of each candidate with its latest record, and whether it is compared."""
    ev = table(spark, d, "evaluations").where(present("candidate_id")).groupBy(folded("candidate_id").alias("cid")).agg(F.max_by("attempt", "seq").alias("attempt"))
    cur = _current(spark, d)
    return ev.join(cur, F.col("cid") == F.col("candidate_id"), "left").select(F.col("cid").alias("candidate_id"), "attempt", "status", F.col("status").isin(*state.COMPARED).alias("compared"))


@query(_with(("jobs",), " SELECT job_id, candidate_id, c_name AS candidate, resource_class FROM jobs JOIN customer ON candidate_id = c_custkey WHERE status = 'leased'"))
def jobs_with_candidates(spark: SparkSession, d: str) -> DataFrame:
    """D3: leased jobs with their candidates."""
    jobs = view(spark, d, "jobs").where("status = 'leased'").select("job_id", "candidate_id", "resource_class")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("candidate"))
    return jobs.join(c, F.col("candidate_id") == F.col("k")).drop("k")


@query(_with(("jobs",), """ SELECT candidate_id, job_id FROM (SELECT candidate_id, job_id, row_number() OVER (PARTITION BY candidate_id ORDER BY seq) AS n FROM jobs
WHERE status = 'leased' AND (worker_id % 3 = 0 OR worker_id = candidate_id % 40)) WHERE n = 1"""))
def completed_job_match(spark: SparkSession, d: str) -> DataFrame:
    """Of a candidate's leased jobs the first whose worker is unknown or the one that reports."""
    jobs = view(spark, d, "jobs").where("status = 'leased'")
    worker = F.when(F.col("worker_id") % 3 != 0, F.col("worker_id"))
    fit = jobs.where(worker.isNull() | (worker == F.col("candidate_id") % 40))
    return fit.groupBy("candidate_id").agg(F.min_by("job_id", "seq").alias("job_id"))


@query(f"""SELECT DISTINCT {sql_folded('candidate_id')} AS candidate_id, CAST(pos - 1 AS BIGINT) AS pos, {sql_folded('p')} AS parent FROM (
  SELECT candidate_id, unnest(parent_ids) AS p, unnest(range(1, len(parent_ids) + 1)) AS pos FROM candidates WHERE coalesce({sql_folded('candidate_id')}, '') <> '') WHERE coalesce({sql_folded('p')}, '') <> ''""")
def parent_links(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their parents in order."""
    c = table(spark, d, "candidates").where(present("candidate_id")).select(folded("candidate_id").alias("candidate_id"), F.posexplode("parent_ids").alias("pos", "p"))
    return c.where(present("p")).select("candidate_id", F.col("pos").cast("long").alias("pos"), folded("p").alias("parent")).distinct()


@query("""
SELECT coalesce(a.k, b.k) AS k, b.v IS NOT NULL AS on_top, coalesce(b.v, a.v) AS v FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier) a
FULL JOIN (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_nationkey = 3) b ON a.k = b.k""")
def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a base with those of an overlay, which wins."""
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), F.lit(False).alias("on_top"))
    top = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(True).alias("on_top"))
    return overlaid(base, top, "k").select("k", "on_top", "v")


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'semi', count(*) FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT 'all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """H1-H5: union of sets, difference, membership and concatenation."""
    li = table(spark, d, "lineitem")
    a, b = (li.where(c).select(F.col("l_suppkey").alias("k")).distinct() for c in ("l_returnflag = 'R'", "l_quantity > 49"))
    made = {"union": a.union(b).distinct(), "except": a.exceptAll(b), "semi": a.join(b, "k", "left_semi"), "all": a.unionByName(b)}
    out = None
    for name, df in made.items():
        one = df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# --- queues and generators ----------------------------------------------------------------------------------------------


@query(_with(("jobs",), " SELECT resource_class, job_id, row_number() OVER (PARTITION BY resource_class ORDER BY attempt, queued_at, seq) AS place FROM jobs WHERE status = 'queued'"))
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    """Queued jobs in the order in which they are served."""
    return queueing.queue_order(view(spark, d, "jobs")).select("resource_class", "job_id", "place")


def _workers(spark: SparkSession, d: str) -> DataFrame:
    classes = view(spark, d, "jobs").select("resource_class").distinct()
    pools = classes.select(F.lit(0).alias("pos"), "resource_class", F.lit(7).alias("slots"), F.lit(1800).alias("lease_timeout_seconds"))
    return queueing.worker_pool(pools)


_WORKERS = """, workers_ AS (SELECT resource_class || '-' || s AS worker_id, resource_class, s FROM (SELECT DISTINCT resource_class FROM jobs), (SELECT unnest(range(1, 8)) AS s))"""


@query(_with(("jobs",), _WORKERS + " SELECT worker_id, resource_class, 'idle' AS status FROM workers_"))
def worker_pool(spark: SparkSession, d: str) -> DataFrame:
    """The workers of each pool."""
    return _workers(spark, d).select("worker_id", "resource_class", "status")


@query(_with(("jobs",), _WORKERS + """, q AS (SELECT resource_class, job_id, row_number() OVER (PARTITION BY resource_class ORDER BY attempt, queued_at, seq) AS place FROM jobs WHERE status = 'queued')
SELECT worker_id, job_id FROM workers_ w JOIN q ON w.resource_class = q.resource_class AND w.s = q.place"""))
def lease_match(spark: SparkSession, d: str) -> DataFrame:
    """Idle workers with the jobs they get."""
    return queueing.match_workers(view(spark, d, "jobs"), _workers(spark, d)).select("worker_id", "job_id")


@query(f"""
SELECT snapshot_id, e.key AS worker, e.value.current_job_id AS job_id, floor((epoch_us(updated_at) - epoch_us(e.value.leased_at)) / 1e6) AS age_seconds FROM (SELECT snapshot_id, updated_at, unnest(map_entries(workers)) AS e FROM workers)
WHERE {sql_folded('e.value.status')} = 'leased' AND (epoch_us(updated_at) - epoch_us(e.value.leased_at)) / 1e6 > coalesce(e.value.lease_timeout_seconds, 1800)""")
def lease_expired(spark: SparkSession, d: str) -> DataFrame:
    """Leases of the snapshots that are older than their timeout, as of the snapshot's own time."""
    slots = table(spark, d, "workers").select("snapshot_id", "updated_at", F.explode("workers").alias("worker", "w"))
    leases = slots.select("snapshot_id", "updated_at", "worker", folded("w.status").alias("status"), F.col("w.current_job_id").alias("job_id"), F.col("w.leased_at").alias("leased_at"), F.xxhash64("snapshot_id", "worker", "w").alias("worker_id"), F.col("w.lease_timeout_seconds").alias("t"))
    timeouts = leases.groupBy("worker_id").agg(F.max("t").alias("lease_timeout_seconds"))
    out = queueing.expired_leases(leases, timeouts, F.col("updated_at"))
    return out.select("snapshot_id", "worker", "job_id", F.floor("age_seconds").cast("double").alias("age_seconds"))


_OPTIONS = """, options AS (SELECT p_brand AS family, p_partkey AS pos, p_type || ':' || p_size AS signature FROM part), tried AS (SELECT DISTINCT p_type || ':' || p_size AS signature FROM part WHERE p_retailprice > 1500)"""


def _options(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    sign = F.concat_ws(":", "p_type", "p_size")
    return part.select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("pos"), sign.alias("signature")), part.where("p_retailprice > 1500").select(sign.alias("signature"))


@query("WITH x AS (SELECT 1)" + _OPTIONS + " SELECT family, pos, signature FROM (SELECT family, pos, signature, row_number() OVER (PARTITION BY family ORDER BY pos) AS n FROM options WHERE signature NOT IN (SELECT signature FROM tried)) WHERE n = 1")
def untried_probes(spark: SparkSession, d: str) -> DataFrame:
    """Each family's first probe that hasn't been tried."""
    options, tried = _options(spark, d)
    return queueing.first_untried(options, tried, "family", ["pos"])


def _axes(spark: SparkSession, d: str) -> DataFrame:
    axis = lambda path, values: F.struct(F.lit(path).alias("path"), F.array(*values).alias("values"))
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("family")).agg(F.min("p_size").alias("p_size")).select("family", F.array(axis("model.depth", [F.lit("2"), size, F.lit("4")]), axis("training.lr", [F.lit("0.1"), size])).alias("axes"))


@query("""WITH f AS (SELECT p_brand AS family, min(p_size) AS s FROM part GROUP BY 1),
o AS (SELECT family, 0 AS a, 0 AS v, 'model.depth' AS path, '2' AS value FROM f UNION ALL SELECT family, 0, 1, 'model.depth', CAST(s AS VARCHAR) FROM f UNION ALL SELECT family, 0, 2, 'model.depth', '4' FROM f
  UNION ALL SELECT family, 1, 0, 'training.lr', '0.1' FROM f UNION ALL SELECT family, 1, 1, 'training.lr', CAST(s AS VARCHAR) FROM f)
SELECT family, path, value FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY a, v) AS n FROM o WHERE value NOT IN ('2', '1')) WHERE n = 1""")
def next_mutation(spark: SparkSession, d: str) -> DataFrame:
    """Each family's first value, axis by axis, that hasn't been tried."""
    options = queueing.mutations(_axes(spark, d)).withColumn("signature", F.col("value"))
    tried = spark.createDataFrame([("2",), ("1",)], "signature string")
    return queueing.first_untried(options, tried, "family", ["axis_pos", "value_pos"]).select("family", "path", "value")


def _champions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cust = table(spark, d, "customer")
    champions = cust.where("c_nationkey % 3 <> 1").groupBy(F.col("c_nationkey").alias("family")).agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("candidate_id"))
    families = table(spark, d, "nation").select(F.col("n_nationkey").alias("family"))
    compatible = families.select("family", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.pmod(F.col("family") + i, F.lit(25))).alias("compatible"))
    return champions, compatible


@query("""WITH ch AS (SELECT c_nationkey AS f, arg_max(c_custkey, c_acctbal) AS c FROM customer WHERE c_nationkey % 3 <> 1 GROUP BY 1),
l AS (SELECT n_nationkey AS family, i AS pos, ch.c FROM nation, (SELECT unnest(range(5)) AS i), ch WHERE ch.f = (n_nationkey + i) % 25)
SELECT a.family, a.c AS left_parent, b.c AS right_parent FROM l a JOIN l b ON a.family = b.family AND a.pos < b.pos""")
def crossover_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of champions of compatible families."""
    return queueing.crossovers(*_champions(spark, d)).select("family", "left_parent", "right_parent")


@query("""WITH ch AS (SELECT c_nationkey AS f, arg_max(c_custkey, c_acctbal) AS c FROM customer WHERE c_nationkey % 3 <> 1 GROUP BY 1)
SELECT n_nationkey AS family, CASE WHEN n_nationkey % 2 = 0 THEN 'probe' WHEN c IS NOT NULL THEN 'mutation' ELSE 'crossover' END AS kind FROM nation LEFT JOIN ch ON f = n_nationkey""")
def builder_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Each family's option of the first kind that has one."""
    champions, _ = _champions(spark, d)
    families = table(spark, d, "nation").select(F.col("n_nationkey").alias("family"), F.lit(0).cast("long").alias("candidate_id"))
    return queueing.by_precedence(("probe", families.where("family % 2 = 0")), ("mutation", champions), ("crossover", families)).select("family", "kind")


@query("""WITH n AS (SELECT r_regionkey AS pos, r_name AS b FROM region WHERE r_regionkey < 4), m AS (SELECT unnest(range(1, 16)) AS mask),
s AS (SELECT mask, string_agg(b, '+' ORDER BY pos) AS members, count(*) AS n FROM m, n WHERE mask & (1 << pos) <> 0 GROUP BY mask)
SELECT members, CAST(row_number() OVER (ORDER BY mask) AS INTEGER) AS place FROM s WHERE n >= 2""")
def capstone_combos(spark: SparkSession, d: str) -> DataFrame:
    """All subsets of two or more winners."""
    winners = table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("branch"))
    return queueing.combinations(winners).select(F.array_join("members", "+").alias("members"), "place")


@query("""WITH w AS (SELECT n_nationkey AS pos, n_name AS b FROM nation WHERE n_nationkey < 7)
SELECT members, CAST(place AS INTEGER) AS place FROM (SELECT l.b || '+' || r.b AS members, row_number() OVER (ORDER BY l.pos, r.pos) AS place FROM w l JOIN w r ON l.pos < r.pos) WHERE place <= 16""")
def capstone_pairs(spark: SparkSession, d: str) -> DataFrame:
    """With too many winners for all subsets, pairs, cut to sixteen."""
    winners = table(spark, d, "nation").where("n_nationkey < 7").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("branch"))
    return queueing.combinations(winners).select(F.array_join("members", "+").alias("members"), "place")


@query("""WITH known AS (SELECT n_name AS family FROM nation WHERE n_regionkey < 3), p AS (SELECT s_name AS family, s_suppkey AS seq FROM supplier WHERE s_nationkey % 4 <> 0 UNION ALL SELECT n_name, n_nationkey FROM nation)
SELECT family, false AS added FROM known UNION ALL SELECT DISTINCT family, true FROM p WHERE family NOT IN (SELECT family FROM known)""")
def expansion_merge(spark: SparkSession, d: str) -> DataFrame:
    """Known families and approved proposals of new ones."""
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    known = nation.where("n_regionkey < 3").select(F.col("n_name").alias("family"), F.lit("{}").alias("body"))
    refused = F.when(F.col("s_nationkey") % 4 == 0, F.lit(False))
    proposals = supplier.select(F.col("s_name").alias("family"), F.col("s_suppkey").alias("seq"), F.lit("{}").alias("body"), refused.alias("approved"))
    proposals = proposals.unionByName(nation.select(F.col("n_name").alias("family"), F.col("n_nationkey").cast("long").alias("seq"), F.lit("{}").alias("body"), F.lit(True).alias("approved")))
    return queueing.merged_proposals(known, proposals).select("family", "added")


@query("""WITH f AS (SELECT n_nationkey AS family, (n_nationkey * 7) % 11 AS credits, n_nationkey % 3 AS probes, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE (n_nationkey % 5) / 10.0 END AS champion, n_nationkey % 6 AS plateau FROM nation)
SELECT CAST(family AS BIGINT) AS family, round(CAST(credits AS DOUBLE) + CASE WHEN probes > 0 THEN 1 ELSE 0 END + coalesce(champion, 0) - 0.25 * plateau, 6) AS priority FROM f WHERE credits >= 1""")
def family_priority(spark: SparkSession, d: str) -> DataFrame:
    """The priority of families that can pay."""
    return _funded(spark, d).where("credits >= 1").select("family", F.round(F.col("credits") + F.when(F.col("probes") > 0, 1.0).otherwise(0.0) + F.coalesce("champion", F.lit(0.0)) - 0.25 * F.col("plateau"), 6).alias("priority"))


def _funded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(k.alias("family"), k.alias("seq"), ((k * 7) % 11).alias("credits"), (k % 3).alias("probes"), F.when(k % 4 != 0, (k % 5) / 10.0).alias("champion"), (k % 6).alias("plateau"), (k % 3 + 1).alias("options"))


@query("""WITH RECURSIVE f AS (SELECT CAST(n_nationkey AS BIGINT) AS family, (n_nationkey * 7) % 11 AS credits, n_nationkey % 3 AS probes, CASE WHEN n_nationkey % 4 = 0 THEN 0.0 ELSE (n_nationkey % 5) / 10.0 END AS champion, n_nationkey % 6 AS plateau, n_nationkey % 3 + 1 AS options FROM nation),
s AS (
  SELECT 0 AS pick, CAST(NULL AS BIGINT) AS family, CAST([] AS BIGINT[]) AS past
  UNION ALL
  SELECT pick + 1, n.family, list_append(past, n.family) FROM s, LATERAL (
    SELECT f.family FROM f WHERE credits - len(list_filter(past, lambda x: x = f.family)) >= 1 AND options > len(list_filter(past, lambda x: x = f.family))
    ORDER BY CAST(credits AS DOUBLE) - len(list_filter(past, lambda x: x = f.family)) + CASE WHEN probes > len(list_filter(past, lambda x: x = f.family)) THEN 1 ELSE 0 END + champion - 0.25 * plateau DESC, f.family LIMIT 1) n WHERE pick < 10)
SELECT family, CAST(pick AS BIGINT) AS pick FROM s WHERE pick > 0""")
def queue_fill(spark: SparkSession, d: str) -> DataFrame:
    """The families picked for ten open slots, each pick changing the next."""
    return queueing.fill_queue(_funded(spark, d), 10)


# --- Pareto layers, lineage ---------------------------------------------------------------------------------------------


@query(_with(("points",), " SELECT candidate_id FROM points a WHERE NOT EXISTS (SELECT 1 FROM points b WHERE b.gain >= a.gain AND b.thrift >= a.thrift AND (b.gain > a.gain OR b.thrift > a.thrift))"))
def pareto_front0(spark: SparkSession, d: str) -> DataFrame:
    """The points that no other dominates."""
    return pareto.front(view(spark, d, "points"), ["gain", "thrift"]).select("candidate_id")


@query(_with(("points",), """,
dom AS (SELECT a.candidate_id AS lo, b.candidate_id AS hi FROM points a JOIN points b ON b.gain >= a.gain AND b.thrift >= a.thrift AND (b.gain > a.gain OR b.thrift > a.thrift)),
lay AS (SELECT candidate_id, CAST(0 AS BIGINT) AS layer FROM points UNION SELECT dom.lo, lay.layer + 1 FROM lay JOIN dom ON dom.hi = lay.candidate_id)
SELECT candidate_id, max(layer) AS layer, CAST([] AS BIGINT[]) AS dominated_by FROM lay GROUP BY candidate_id""", True))
def pareto_rank(spark: SparkSession, d: str) -> DataFrame:
    """The layer of each point, the front being 0. dominated_by is empty, as each layer is made without those above it."""
    return pareto.layers(view(spark, d, "points"), "candidate_id", ["gain", "thrift"]).withColumn("dominated_by", F.array().cast("array<bigint>"))


@query(_with(("points",), """, f AS (SELECT * FROM points a WHERE NOT EXISTS (SELECT 1 FROM points b WHERE b.gain >= a.gain AND b.thrift >= a.thrift AND (b.gain > a.gain OR b.thrift > a.thrift)))
SELECT a.candidate_id, count(f.candidate_id) AS dominated_by, min(f.candidate_id) AS first_dominator FROM points a LEFT JOIN f ON f.gain >= a.gain AND f.thrift >= a.thrift AND (f.gain > a.gain OR f.thrift > a.thrift) GROUP BY 1"""))
def pareto_dominators(spark: SparkSession, d: str) -> DataFrame:
    """How many points of the front dominate each point, and one of them."""
    return pareto.dominators(view(spark, d, "points"), "candidate_id", ["gain", "thrift"])


@query(_with(("lineage",), """,
t AS (SELECT id, CAST(1 AS BIGINT) AS depth FROM lineage WHERE parent IS NULL UNION ALL SELECT l.id, t.depth + 1 FROM lineage l JOIN t ON l.parent = t.id)
SELECT id, depth FROM t""", True))
def lineage_depth(spark: SparkSession, d: str) -> DataFrame:
    """1 more than the depth of the parent; 1 without one."""
    from trialforge.operators.hierarchy import hierarchy

    tree = hierarchy(view(spark, d, "lineage").select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent")))
    return tree.select(F.col("candidate_id").cast("long").alias("id"), (F.col("node_depth") + 1).alias("depth"))


@query("""WITH RECURSIVE up AS (
  SELECT p_partkey AS id, p_partkey AS anc, 0 AS far FROM part UNION ALL SELECT up.id, p.p_partkey, far + 1 FROM up JOIN part p ON p.p_partkey = up.anc // 2 WHERE up.anc > 1),
near AS (SELECT id, anc % 5 AS k, arg_min(p_size, far) AS size FROM up JOIN part ON p_partkey = anc GROUP BY ALL)
SELECT CAST(id AS VARCHAR) AS candidate_id, '{' || string_agg('"k' || k || '": {"depth": ' || size || ', "seed": 1}', ', ' ORDER BY k) || ', "model": {"depth": 1, "type": "base"}}' AS config
FROM (SELECT id, k, size FROM near) GROUP BY id""")
def resolved_config(spark: SparkSession, d: str) -> DataFrame:
    """I8: each candidate's whole configuration along its lineage. A candidate sets one of five keys; the others come from the nearest
    ancestor that sets them."""
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    parents = F.when(k > 1, F.array(F.floor(k / 2).cast("string"))).otherwise(F.array().cast("array<string>"))
    patch = F.format_string('{"k%d": {"depth": %d, "seed": 1}}', k % 5, "p_size")
    c = part.select(k.cast("string").alias("candidate_id"), parents.alias("parent_ids"), patch.alias("config_patch"))
    return configs.resolved(c, '{"model": {"depth": 1, "type": "base"}}')


@query("""SELECT 'c' || n_nationkey AS candidate_id, '{"model": {"depth": 1}, "seed": ' || n_nationkey || '}' AS config FROM nation""")
def crossover_config(spark: SparkSession, d: str) -> DataFrame:
    """The configuration of a candidate with two parents. Each parent comes with the baseline, so where the second has the
    baseline's value it replaces what the first had patched: the depth is lost, the seed stays."""
    k = F.col("n_nationkey").cast("string")
    none = F.array().cast("array<string>")
    row = lambda kind, parents, patch: F.struct(F.concat(F.lit(kind), k).alias("candidate_id"), parents.alias("parent_ids"), patch.alias("config_patch"))
    first = row("a", none, F.concat(F.lit('{"model": {"depth": 9'), k, F.lit("}}")))
    second = row("b", none, F.concat(F.lit('{"seed": '), k, F.lit("}")))
    child = row("c", F.array(F.concat(F.lit("a"), k), F.concat(F.lit("b"), k)), F.lit("{}"))
    c = table(spark, d, "nation").select(F.explode(F.array(first, second, child)).alias("x")).select("x.*")
    return configs.resolved(c, '{"model": {"depth": 1}, "seed": 0}').where("candidate_id like 'c%'")


# --- detectors ----------------------------------------------------------------------------------------------------------


@query(_with(("costs",), """ SELECT branch, round(sum(elapsed_sec), 1) AS total_cost, round(sum(elapsed_sec) / count(*), 1) AS avg_cost, round(sum(elapsed_sec) / nullif(count(*) FILTER (WHERE verdict = 'PROMOTE'), 0), 1) AS cost_per_promote,
 count(*) AS n_experiments, count(*) FILTER (WHERE verdict = 'PROMOTE') AS n_promotions, CAST(sum(tokens_used) AS BIGINT) AS total_tokens FROM costs GROUP BY branch"""))
def branch_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost and tokens of each branch."""
    return detectors.branch_costs(view(spark, d, "costs"))


def _rejected(spark: SparkSession, d: str) -> DataFrame:
    """Rejections with their gates: two texts of each of the order's lines, none for some."""
    gates = view(spark, d, "gates").groupBy("seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gate_text", "second_text"))), lambda x: F.array(x["gate_text"], x["second_text"]))).alias("g"))
    runs = view(spark, d, "experiments").join(gates, "seq", "left")
    return runs.withColumn("failures", F.when(F.col("seq") % 3 != 0, F.col("g"))).drop("g")


_FAILURES = """,
texts AS (SELECT seq, pos, 0 AS w, gate_text AS t FROM gates UNION ALL SELECT seq, pos, 1, second_text FROM gates),
firsts AS (SELECT seq, t FROM texts WHERE w = 0 AND seq % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY pos, t) = 1)"""
_GATES = _FAILURES + f""",
hits AS (
  SELECT {_GATE_CASE} AS gate FROM (SELECT lower(t) AS s FROM texts JOIN experiments USING (seq) WHERE verdict = 'REJECT' AND seq % 3 <> 0)
  UNION ALL SELECT {_REASON_CASE} FROM experiments WHERE verdict = 'REJECT' AND seq NOT IN (SELECT seq FROM firsts))"""


@query(_with(("experiments", "gates"), _GATES + " SELECT gate, count(*) AS n FROM hits GROUP BY gate"))
def gate_failures(spark: SparkSession, d: str) -> DataFrame:
    """How often each category of gate failed."""
    return detectors.gate_counts(_rejected(spark, d).where("verdict = 'REJECT'"))


@query(_with(("experiments", "gates"), _GATES + " SELECT gate, n, round(n / total, 3) AS rate FROM (SELECT gate, count(*) AS n, (SELECT count(*) FROM experiments WHERE verdict = 'REJECT') AS total FROM hits GROUP BY gate) WHERE total >= 10 AND n / total >= 0.25"))
def binding_gates(spark: SparkSession, d: str) -> DataFrame:
    """Categories that failed in a quarter of the rejections or more."""
    return detectors.binding_gates(_rejected(spark, d).where("verdict = 'REJECT'"), threshold=0.25)


_TYPES = _FAILURES + f""",
typed AS (SELECT branch, seq, CASE WHEN verdict = 'REJECT' THEN CASE WHEN t IS NOT NULL THEN 'hard_gate:' || {_GATE_CASE} WHEN starts_with(reason, 'score=') THEN 'soft_below_champion' ELSE 'rejected_other' END
  WHEN verdict = 'MARGINAL' THEN 'marginal' ELSE 'other' END AS failure_type
  FROM (SELECT e.branch, e.seq, e.verdict, e.reason, f.t, lower(f.t) AS s FROM experiments e LEFT JOIN firsts f USING (seq)) WHERE verdict <> 'PROMOTE')"""


@query(_with(("experiments", "gates"), _TYPES + " SELECT branch, failure_type, count(*) AS n FROM typed GROUP BY GROUPING SETS ((failure_type), (branch, failure_type))"))
def failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Runs by failure type, in all and for each branch."""
    return detectors.failure_histogram(_rejected(spark, d))


@query(_with(("experiments", "gates"), _TYPES + """ SELECT branch, failure_type, n FROM (SELECT branch, failure_type, count(*) AS n, row_number() OVER (PARTITION BY branch ORDER BY count(*) DESC, min(seq)) AS k FROM typed GROUP BY branch, failure_type) WHERE k = 1"""))
def dominant_failure(spark: SparkSession, d: str) -> DataFrame:
    """Each branch's commonest failure type."""
    return detectors.dominant_failure(_rejected(spark, d))


_EFFICIENCY = """,
per AS (SELECT branch, count(*) AS n_runs, count(*) FILTER (WHERE verdict = 'PROMOTE') AS n_promotions, arg_min(cycle, seq) FILTER (WHERE verdict = 'PROMOTE') AS first_promote_cycle FROM experiments GROUP BY branch)"""


@query(_with(("experiments", "branches"), _EFFICIENCY + " SELECT branch, n_runs, n_promotions, first_promote_cycle, round(n_promotions / greatest(n_experiments, 1), 3) AS budget_roi, n_promotions = 0 AS never_promoted FROM per LEFT JOIN branches USING (branch)"))
def efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Runs, promotions and yield of each branch."""
    return detectors.efficiency_by_branch(view(spark, d, "experiments"), view(spark, d, "branches"))


@query(_with(("experiments",), """, per AS (SELECT axis_branch, count(*) AS n, count(*) FILTER (WHERE verdict = 'PROMOTE') AS p FROM experiments GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_experiments, CAST(sum(p) AS BIGINT) AS total_promotions, round(coalesce(sum(n) FILTER (WHERE p = 0), 0) / greatest(sum(n), 1), 3) AS waste_rate FROM per"""))
def efficiency_totals(spark: SparkSession, d: str) -> DataFrame:
    """The share of runs on branches that never promoted."""
    runs = view(spark, d, "experiments").withColumn("branch", F.col("axis_branch").cast("string"))
    spent = runs.groupBy("branch").agg(F.count(F.lit(1)).alias("n_experiments"))
    return detectors.efficiency_totals(detectors.efficiency_by_branch(runs, spent))


@query(_with(("experiments",), """, a AS (SELECT axis_branch AS branch, CASE WHEN coalesce(delta, '') = '' THEN 'unknown' ELSE trim(split_part(delta, ':', 1)) END AS axis, composite_score FROM experiments),
g AS (SELECT branch, axis, count(*) AS r, count(composite_score) AS n_scores, max(composite_score) - min(composite_score) AS x FROM a GROUP BY 1, 2)
SELECT branch, axis, n_scores, round(x, 6) AS score_range FROM (SELECT *, sum(r) OVER (PARTITION BY branch) AS every FROM g) WHERE every >= 3 AND n_scores >= 2 AND x < 0.25"""))
def flat_axes(spark: SparkSession, d: str) -> DataFrame:
    """Axes whose scores hardly differ."""
    return detectors.flat_axes(view(spark, d, "experiments").withColumn("branch", F.col("axis_branch")), 3, 0.25)


_CYCLE = 84


@query(_with(("branches",), f""",
p AS (SELECT *, {_CYCLE} - last_explored_cycle >= 10 AND status = 'active' AS stale, round(0.3 * current_ev + 0.4 / sqrt(1 + n_experiments) + 0.3 * least(1.0, ({_CYCLE} - last_explored_cycle) / 3.0), 6) AS base FROM branches WHERE status NOT IN ('exhausted', 'converged') AND budget > 0)
SELECT branch, CASE WHEN stale THEN 999.0::DOUBLE ELSE base::DOUBLE END AS priority, CAST(row_number() OVER (ORDER BY stale DESC, CASE WHEN stale THEN branch END, CASE WHEN stale THEN 999.0 ELSE base END DESC, n_experiments, budget DESC, branch) AS INTEGER) AS place FROM p"""))
def branch_rank(spark: SparkSession, d: str) -> DataFrame:
    """Branches in the order in which they are explored."""
    return detectors.branch_priority(view(spark, d, "branches"), _CYCLE)


@query(_with(("experiments", "scored", "branches"), f""",
tail AS (SELECT branch, verdict FROM experiments QUALIFY row_number() OVER (PARTITION BY branch ORDER BY seq DESC) <= 4),
stuck AS (SELECT branch FROM tail JOIN branches USING (branch) WHERE status <> 'exhausted' AND n_experiments >= 4 GROUP BY branch HAVING count(*) >= 4 AND count(*) FILTER (WHERE verdict = 'PROMOTE') = 0),
o AS (SELECT count(*) AS n FROM branches WHERE status NOT IN ('exhausted', 'converged') AND budget > 0 AND branch NOT IN (SELECT branch FROM stuck)),
l AS (SELECT max(cycle) AS c FROM experiments WHERE verdict = 'PROMOTE'),
r AS (SELECT count(*) >= 8 AND bool_and(abs(composite_score - champion_score) < 0.005) AS ok FROM (SELECT * FROM scored ORDER BY seq DESC LIMIT 8))
SELECT reason = 'converged' AS converged, reason, n_open FROM (SELECT n AS n_open, CASE WHEN n > 0 THEN 'active_branches' WHEN {_CYCLE} - c < 5 THEN 'recent_champion' WHEN NOT ok THEN 'meaningful_deltas' ELSE 'converged' END AS reason FROM o, l, r)"""))
def convergence(spark: SparkSession, d: str) -> DataFrame:
    """Whether a lab has converged, and if not, why."""
    return detectors.convergence(scored_experiments(spark, d), view(spark, d, "branches"), _CYCLE)


# --- state --------------------------------------------------------------------------------------------------------------


@query(_with(("jobs",), " SELECT count(*) FILTER (WHERE status = 'queued') AS n_queued, count(*) FILTER (WHERE status = 'leased') AS n_leased, count(*) FILTER (WHERE status = 'finished') AS n_finished, count(*) AS n_jobs FROM jobs"))
def lab_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by status."""
    return state.queue_counts(view(spark, d, "jobs"))


@query("""SELECT snapshot_id, family, CAST(f ->> '$.credits' AS BIGINT) AS credits FROM (
  SELECT DISTINCT snapshot_id, family, json_extract(family_funding, '$."' || family || '"') AS f FROM (SELECT snapshot_id, family_funding, unnest(json_keys(family_funding)) AS family FROM frontier WHERE json_valid(family_funding) AND json_type(family_funding) = 'OBJECT'))""")
def family_credits(spark: SparkSession, d: str) -> DataFrame:
    """The credits of each family in the snapshots, flattened from their map."""
    parsed = table(spark, d, "frontier").select("snapshot_id", F.from_json("family_funding", "map<string, struct<credits:bigint>>", {"mode": "PERMISSIVE"}).alias("m"), F.try_parse_json("family_funding").alias("v"))
    flat = parsed.where(F.col("v").isNotNull()).select("snapshot_id", F.explode("m").alias("family", "f"))
    return flat.select("snapshot_id", "family", "f.credits").distinct()


@query("SELECT event_id, step_count, total FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS step_count, CAST(sum(CAST(value AS DECIMAL(38, 6))) OVER (ORDER BY event_id) AS DOUBLE) AS total FROM events) WHERE step_count % 500 = 0")
def checkpoint_ticks(spark: SparkSession, d: str) -> DataFrame:
    """totals at every five hundredth step."""
    return state.ticks(table(spark, d, "events").select("event_id", F.col("value").alias("amount")), "event_id", 500)


@query(_with(("jobs",), """, p AS (SELECT resource_class, count(*) AS n, count(*) FILTER (WHERE status IN ('queued', 'leased')) AS pending, min(job_id) % 4 AS audits FROM jobs GROUP BY 1)
SELECT resource_class, CASE WHEN n % 6 = 0 THEN 'checkpoint' WHEN audits > 0 THEN 'audit' WHEN pending > 0 THEN 'supervisor' ELSE 'frame_break' END AS phase FROM p"""))
def phase_router(spark: SparkSession, d: str) -> DataFrame:
    """The rules of the phase over counts of jobs."""
    one = view(spark, d, "jobs").groupBy("resource_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("queued", "leased")).alias("pending"), (F.min("job_id") % 4).alias("audits"))
    phase = state.phase(F.lit(True), F.lit(True), F.col("n"), 6, F.lit(False), F.col("audits"), F.col("pending"), state.plateaued(F.lit(None).cast("boolean"), F.col("n"), 3))
    return one.select("resource_class", phase.alias("phase"))


@query(_with(("branches",), """ SELECT branch, CAST((budget <= 0)::INT + (n_improvements <= 0)::INT + (current_ev IS NULL)::INT AS BIGINT) AS n_issues,
 CASE WHEN status = 'exhausted' THEN 'degraded' WHEN budget <= 0 OR n_improvements <= 0 OR current_ev IS NULL THEN 'needs_setup' ELSE 'ready' END AS health FROM branches"""))
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Failed checks and the health that follows from them."""
    problems = state.issues({"no budget": F.col("budget") > 0, "no improvement": F.col("n_improvements") > 0, "no expectation": F.col("current_ev").isNotNull()})
    b = view(spark, d, "branches").withColumn("p", problems)
    return b.select("branch", F.size("p").cast("long").alias("n_issues"), state.health(F.col("p"), F.col("status") == "exhausted").alias("health"))


@query(f"""WITH {_CURRENT}, t AS (SELECT * FROM (SELECT fam, id, st, row_number() OVER (PARTITION BY fam ORDER BY seq DESC, id) AS k FROM cur WHERE fam IN (SELECT fam FROM cur GROUP BY fam HAVING count(*) FILTER (WHERE st = 'promoted') = 0)) WHERE k <= 5)
SELECT fam AS family, '[' || string_agg('{{"candidate_id":"' || id || '"' || CASE WHEN st IS NULL THEN '' ELSE ',"status":"' || st || '"' END || '}}', ',' ORDER BY k) || ']' AS recent FROM t WHERE fam <> '' GROUP BY fam""")
def scout_requests(spark: SparkSession, d: str) -> DataFrame:
    """Families without a promotion, with their last five candidates as JSON."""
    cur = _current(spark, d)
    stuck = cur.where(present("family")).groupBy("family").agg(F.count_if(F.col("status") == "promoted").alias("n")).where("n = 0")
    return state.scout_requests(cur, stuck)


# --- time ---------------------------------------------------------------------------------------------------------------


@query("""SELECT o.o_orderkey AS seq, e.value AS last_value FROM orders o ASOF LEFT JOIN (SELECT user_id, ts - INTERVAL 1500 DAY AS ts, value, event_id FROM events) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its user's last event before it."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"))
    events = table(spark, d, "events").select("user_id", (F.col("ts") - F.expr("INTERVAL 1500 DAYS")).alias("ts"), "value", "event_id")
    return temporal.asof_join(orders, events, "user_id", "at", "ts", "value", "event_id").select("seq", F.col("value").alias("last_value"))


_INTERVALS = "i AS (SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS a, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + o_orderkey % 5 AS b FROM orders)"


@query(f"WITH {_INTERVALS} SELECT id FROM i t WHERE id % 100 <> 0 AND NOT EXISTS (SELECT 1 FROM i x WHERE x.id % 100 = 0 AND t.a <= x.b + 2 AND t.b >= x.a - 2)")
def interval_purge(spark: SparkSession, d: str) -> DataFrame:
    """Training rows that overlap no test interval, with a gap of two days."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("a"), (day + F.col("o_orderkey") % 5).alias("b"))
    return temporal.purged(i.where("id % 100 <> 0"), i.where("id % 100 = 0"), "a", "b", 2, 30).select("id")


@query(_with(("experiments",), """, e AS (SELECT min(cycle) AS a, max(cycle) + 1 AS z FROM experiments),
w AS (SELECT CAST(k AS BIGINT) AS fold, a, a + 24 + k * 12 AS b, a + 25 + k * 12 AS c, a + 31 + k * 12 AS e FROM e, (SELECT unnest(range(0, (SELECT z - a FROM e))) AS k) WHERE a + 31 + k * 12 <= z)
SELECT fold, round(avg(composite_score) FILTER (WHERE cycle >= a AND cycle < b), 6) AS train_mean, round(avg(composite_score) FILTER (WHERE cycle >= c AND cycle < e), 6) AS test_mean FROM w, experiments GROUP BY fold"""))
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """F16: expanding windows with a dead zone before each test window."""
    runs = view(spark, d, "experiments")
    ends = runs.agg(F.min("cycle").alias("first"), F.max("cycle").alias("last")).first()
    first, last = (0, 0) if ends["first"] is None else (ends["first"], ends["last"] + 1)
    windows = temporal.walk_forward(first, last, 24, 6, 12, 1, spark)
    out = temporal.walk_forward_scores(runs, "cycle", "composite_score", windows)
    return out.select(F.col("fold").cast("long").alias("fold"), F.round("train_mean", 6).alias("train_mean"), F.round("test_mean", 6).alias("test_mean"))


@query(_with(("experiments",), """, m AS (SELECT cycle, avg(composite_score) - 2.5 AS s FROM experiments GROUP BY cycle)
SELECT round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, round(1 - stddev_pop(s) / avg(s), 4) AS consistency, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS passed FROM m"""))
def walk_forward_gate(spark: SparkSession, d: str) -> DataFrame:
    """The share of positive folds and their consistency."""
    m = view(spark, d, "experiments").groupBy("cycle").agg((F.avg("composite_score") - 2.5).alias("s"))
    return temporal.gate(m, F.col("s")).select(F.round("positive_share", 6).alias("positive_share"), F.round("consistency", 4).alias("consistency"), "passed")


@query(_with(("experiments", "scored"), """, r AS (SELECT seq, branch, composite_score / nullif(champion_score, 0) AS ratio FROM scored), q AS (SELECT seq, avg(ratio) OVER (PARTITION BY branch ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r FROM r)
SELECT seq, round(r, 6) AS rolling_ratio, CASE WHEN r > 1.1 THEN 'suspicious' WHEN r >= 0.9 THEN 'healthy' WHEN r >= 0.7 THEN 'moderate' WHEN r >= 0.5 THEN 'concerning' WHEN r IS NOT NULL THEN 'broken' END AS band FROM q"""))
def decay_ratio(spark: SparkSession, d: str) -> DataFrame:
    """How test scores fall behind validation scores."""
    out = temporal.decay(scored_experiments(spark, d), "branch", "seq", F.col("champion_score"), F.col("composite_score"), 10)
    return out.select("seq", F.round("rolling_ratio", 6).alias("rolling_ratio"), "band")
