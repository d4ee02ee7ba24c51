"""Queries over a lab's state: documents and logs read and written, the phase that follows, funding, windows, runs and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trialforge.functions import metrics
from trialforge.functions.lineage import shared_folder
from trialforge.functions.text import folded, present, sql_folded
from trialforge.operators import detectors, lab, ordered, pareto, queueing, runner, state, temporal
from trialforge.plans.reference import _CURRENT, _FOLD, _current, _folded_runs, _with
from trialforge.sources import files
from trialforge.sources.adapters import view
from trialforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- state documents ------------------------------------------------------------------------------------------------------

_CONFIG = {
    "branches": {"mission": "try", "production_baseline": {"experiment_id": "base", "description": "start", "seed_metrics": {"search_eval": 0.41, "selection_eval": 0.40}}, "families": {
        "width": {"description": "wider", "resource_class": "cpu", "funding": {"initial_credits": 4}, "cheap_probes": [{"name": "a"}, {"name": "b"}], "frame_break": {"plateau_window": 3}},
        "depth": {"description": "deeper", "cheap_probes": []}}},
    "evaluation": {"search": {"path": "search.primary_metric"}, "selection": {"path": "selection.primary_metric"}, "final": {"path": "final.primary_metric", "enabled": False}, "prediction_tests": [{"name": "shift", "path": "challenges.shift.primary_metric"}]},
    "runtime": {"checkpoint_interval": 6, "plateau": {"window": 3}, "workers": {"pools": [{"resource_class": "cpu", "slots": 2}, {"resource_class": "gpu", "slots": 1, "lease_timeout_seconds": 60}]}},
}


def _with_config(spark: SparkSession, root: str) -> lab.Lab:
    for name, cfg in _CONFIG.items():
        files.write_text(spark, f"{root}/{name}.yaml", json.dumps(cfg))
    return lab.load(spark, root)


def _fixture(spark: SparkSession, root: str, audit: bool) -> None:
    """A lab in one of two named states: an audit that waits at step 3, or a plateau without probes at step 8."""
    one = _with_config(spark, root)
    lab.bootstrap(one, "2026-01-01T00:00:00+00:00")
    fund = one.frontier["family_funding"]
    fund["width"] |= {"remaining_cheap_probes": int(audit), "plateau_counter": 1 if audit else 3, "credits": 2}
    one.runtime |= {"step_count": 3 if audit else 8, "stagnation_counter": 1 if audit else 3}
    one.frontier |= {"audit_queue": ["width_probe_1"] if audit else [], "frame_break_required": not audit}
    lab.save(one)


@query("""SELECT 'audit' AS fixture, CAST(3 AS BIGINT) AS step_count, 'audit' AS next_phase, CAST(1 AS BIGINT) AS n_audit, CAST(0 AS BIGINT) AS pending_candidates, CAST(1 AS BIGINT) AS remaining_cheap_probes,
  CAST(3 AS BIGINT) AS total_workers, 'base' AS global_champion, '{"depth": 6, "width": 2}' AS family_credits
UNION ALL SELECT 'frame_break', 8, 'frame_break', 0, 0, 0, 3, 'base', '{"depth": 6, "width": 2}'""")
def state_phase(spark: SparkSession, d: str) -> DataFrame:
    """Two named states, read from their files, with the phase that follows from each."""
    out = None
    for name in ("audit", "frame_break"):
        root = _folder(spark, name)
        _fixture(spark, root, name == "audit")
        one = lab.summary(lab.load(spark, root)).select(F.lit(name).alias("fixture"), "step_count", "next_phase", "n_audit", "pending_candidates", "remaining_cheap_probes", "total_workers", "global_champion", "family_credits")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'bootstrapped', 'supervisor', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT), 'base', '{"depth": 6, "width": 4}'),
  (1, 'dispatched', 'supervisor', 0, 2, 0, 3, 'base', '{"depth": 5, "width": 3}'), (2, 'w1 evaluating', 'supervisor', 1, 2, 1, 3, 'base', '{"depth": 5, "width": 3}'),
  (3, 'd1 rejected', 'supervisor', 2, 1, 2, 3, 'base', '{"depth": 5, "width": 3}'), (4, 'w1 promoted', 'supervisor', 3, 0, 3, 3, 'w1', '{"depth": 5, "width": 9}'))
  AS t(n, stage, next_phase, step_count, queued_jobs, finished_jobs, total_candidates, global_champion, family_credits)""")
def lab_smoke(spark: SparkSession, d: str) -> DataFrame:
    """A lab from its bootstrap through dispatch, leases and completed jobs: a candidate that is run again
    and then promoted, and one that fails between."""
    one = lab.bootstrap(_with_config(spark, _folder(spark, "lab")), "2026-01-01T00:00:00+00:00")
    rows = [("bootstrapped", lab.summary(one))]
    specs = [{"candidate_id": "w1", "signature": "s1", "family": "width", "operator_type": "probe"}, {"candidate_id": "d1", "signature": "s2", "family": "depth", "operator_type": "mutation"}]
    lab.dispatch(one, specs, "2026-01-01T00:01:00+00:00")
    rows.append(("dispatched", lab.summary(one)))
    good = {"valid": True, "metrics": {"search": {"primary_metric": 0.5}, "selection": {"primary_metric": 0.5}, "challenges": {"shift": {"primary_metric": 0.3}}}}
    results = {"w1": good, "d1": {"valid": False, "metrics": {"error": "loss is NaN"}}}
    for minute in (2, 3, 4):
        job = lab.lease(one, "cpu-1", f"2026-01-01T00:0{minute}:00+00:00")
        done = lab.complete(one, job["candidate_id"], results[job["candidate_id"]], f"2026-01-01T00:0{minute}:30+00:00", "cpu-1")
        rows.append((f"{done['candidate_id']} {done['status']}", lab.summary(one)))
    names = ["next_phase", "step_count", "queued_jobs", "finished_jobs", "total_candidates", "global_champion", "family_credits"]
    out = None
    for n, (stage, df) in enumerate(rows):
        row = df.select(F.lit(n).cast("long").alias("n"), F.lit(stage).alias("stage"), *names)
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT 'try' AS mission, 'base' AS baseline_id, 'start' AS baseline, 'depth' AS family, 'deeper' AS description, 'cpu' AS resource_class UNION ALL SELECT 'try', 'base', 'start', 'width', 'wider', 'cpu'")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """What a dashboard shows of a lab's configuration."""
    return lab.dashboard(_with_config(spark, _folder(spark, "lab")))


@query("""SELECT n_name AS family, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 6 ELSE n_nationkey % 3 + 1 END AS BIGINT) AS credits, CAST(0 AS BIGINT) AS spent, CAST(coalesce(n, 0) AS BIGINT) AS remaining_cheap_probes, false AS exhausted
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def initial_funding(spark: SparkSession, d: str) -> DataFrame:
    """The funding that families start with: their own credits or six, and the probes that are listed for them."""
    probes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    k = F.col("n_nationkey")
    given = F.when(k % 3 != 0, k % 3 + 1)
    families = table(spark, d, "nation").join(probes, k == F.col("k"), "left")
    return families.select(F.col("n_name").alias("family"), F.coalesce(given, F.lit(lab.INITIAL_CREDITS)).cast("long").alias("credits"), F.lit(0).cast("long").alias("spent"), F.coalesce("n", F.lit(0)).alias("remaining_cheap_probes"), F.lit(False).alias("exhausted"))


@query("""SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 3 ELSE r_regionkey + 4 END AS BIGINT) AS promote_credit,
  CAST(2 AS BIGINT) AS prediction_credit, CAST(20 AS BIGINT) AS global_top_k, CAST(r_regionkey + 1 AS BIGINT) AS family_top_k FROM region""")
def config_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A configuration's numbers, cut to integers, or what a missing key stands for."""
    rows = []
    for r in table(spark, d, "region").select("r_regionkey").collect():  # a row for each configuration
        k = r["r_regionkey"]
        got = lab.defaults({"funding": {} if k % 2 == 0 else {"promote_credit": k + 4.9}, "selection": {"elite_archive": {"family_top_k": k + 1.5}}})
        rows.append((k, got["promote_credit"], got["prediction_credit"], got["global_top_k"], got["family_top_k"]))
    return spark.createDataFrame(rows, "id bigint, promote_credit bigint, prediction_credit bigint, global_top_k bigint, family_top_k bigint")


@query("SELECT 'budget' AS name, CAST(2 AS BIGINT) AS n_entries, CAST(3 AS BIGINT) AS n_experiments UNION ALL SELECT 'branch_beliefs', 1, 3 UNION ALL SELECT 'cycle_counter', 2, 3")
def legacy_state(spark: SparkSession, d: str) -> DataFrame:
    """A10: a lab of the older kind: the documents that are there and its log, with blank lines skipped."""
    root = _folder(spark, "legacy")
    for name, doc in {"budget": {"a": 3, "b": 1}, "branch_beliefs": {"branches": {"a": {"status": "active"}}}, "cycle_counter": {"cycle": 7, "total_experiments": 3}}.items():
        files.write_text(spark, f"{root}/state/{name}.json", json.dumps(doc))
    files.write_text(spark, f"{root}/state/experiment_log.jsonl", '{"branch": "a", "verdict": "REJECT", "cycle": 1}\n\n{"branch": "b", "cycle": 2}\n{"branch": "a", "verdict": "PROMOTE", "hard_gate_failures": ["x"]}\n')
    docs, log = lab.load_legacy(spark, root)
    return spark.createDataFrame([(k, len(v)) for k, v in docs.items()], "name string, n_entries bigint").join(log.agg(F.count(F.lit(1)).alias("n_experiments")), F.lit(True))


# --- readers and writers --------------------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS seq, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0")
def lenient_lines(spark: SparkSession, d: str) -> DataFrame:
    """A3: a log with blank and broken lines, read leniently."""
    path = _folder(spark, "log")
    k = F.col("n_nationkey")
    line = F.when(k % 5 == 0, F.concat(F.lit('{"seq": '), k.cast("string"))).otherwise(F.to_json(F.struct(k.cast("long").alias("k"), F.col("n_name").alias("name"))))
    table(spark, d, "nation").select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)
    return files.read_lines(spark, path, "k bigint, name string", "drop").select(F.col("k").alias("seq"), "name")


@query("SELECT CAST(r_regionkey AS BIGINT) AS seq, CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region")
def named_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents written one by one, each in one step, and read in the order of their names; others in the folder aren't."""
    path = _folder(spark, "docs")
    for r in table(spark, d, "region").collect():  # a document for each
        files.write_text(spark, f"{path}/{r['r_regionkey']:02d}_patch.json", json.dumps({"id": r["r_regionkey"], "name": r["r_name"]}, indent=1))
    files.write_text(spark, f"{path}/other.json", "{}")
    return files.read_named(spark, path, "*patch*.json", "id bigint, name string").select(F.col("seq").cast("long").alias("seq"), "id", "name")


@query("SELECT '- `' || n_name || '` in ' || n_regionkey AS line FROM nation UNION ALL SELECT 'again ' || n_name FROM nation WHERE n_regionkey = 1")
def text_log(spark: SparkSession, d: str) -> DataFrame:
    """Lines made from a template, added to a log twice and read again."""
    path = _folder(spark, "log")
    n = table(spark, d, "nation")
    files.append_text(n.select("n_name", "n_regionkey"), path, "- `%s` in %d")
    files.append_text(n.where("n_regionkey = 1").select("n_name"), path, "again %s")
    return files.read_texts(spark, path).select(F.col("value").alias("line"))


@query("SELECT r_name AS name FROM region")
def created_once(spark: SparkSession, d: str) -> DataFrame:
    """A file that is only made where it is missing: the second writer changes nothing."""
    path = _folder(spark, "once")
    files.create_if_absent(table(spark, d, "region").select(F.col("r_name").alias("name")), path)
    files.create_if_absent(table(spark, d, "nation").select(F.col("n_name").alias("name")), path)
    return files.read_lines(spark, path, "name string").select("name")


# --- snapshots of the frontier --------------------------------------------------------------------------------------------

_FUNDING = """
funding AS (SELECT DISTINCT snapshot_id, family, json_extract(f, '$."' || family || '"') AS x FROM (
  SELECT snapshot_id, family_funding AS f, unnest(json_keys(family_funding)) AS family FROM frontier WHERE json_valid(family_funding) AND json_type(family_funding) = 'OBJECT')),
per AS (SELECT snapshot_id, family, TRY_CAST(x ->> '$.credits' AS BIGINT) AS credits, coalesce(TRY_CAST(x ->> '$.remaining_cheap_probes' AS BIGINT), 0) AS probes, coalesce(TRY_CAST(x ->> '$.plateau_counter' AS BIGINT), 0) AS plateau FROM funding)"""


def _funding(spark: SparkSession, d: str) -> DataFrame:
    kind = "map<string, struct<credits:bigint, remaining_cheap_probes:bigint, plateau_counter:bigint>>"
    parsed = table(spark, d, "frontier").select("snapshot_id", F.from_json("family_funding", kind, {"mode": "PERMISSIVE"}).alias("m"), F.try_parse_json("family_funding").alias("v")).where(F.col("v").isNotNull())
    flat = parsed.select("snapshot_id", F.explode("m").alias("family", "f"))
    return flat.select("snapshot_id", "family", "f.credits", F.coalesce("f.remaining_cheap_probes", F.lit(0)).alias("probes"), F.coalesce("f.plateau_counter", F.lit(0)).alias("plateau")).distinct()


@query(f"WITH {_FUNDING} SELECT snapshot_id, CAST(sum(probes) AS BIGINT) AS remaining_cheap_probes FROM per GROUP BY 1")
def probes_left(spark: SparkSession, d: str) -> DataFrame:
    """The cheap probes that all families of a snapshot have left; null counts as none."""
    return _funding(spark, d).groupBy("snapshot_id").agg(F.sum("probes").alias("remaining_cheap_probes"))


@query(f"WITH {_FUNDING} SELECT snapshot_id, string_agg(family || '=' || coalesce(CAST(credits AS VARCHAR), 'none'), ',' ORDER BY family) AS family_credits FROM per GROUP BY 1")
def family_credit_maps(spark: SparkSession, d: str) -> DataFrame:
    """A map from family to credits for each snapshot, here as text."""
    maps = _funding(spark, d).groupBy("snapshot_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "credits")))).alias("m"))
    entry = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("none")))
    return maps.select("snapshot_id", F.array_join(F.transform(F.map_entries("m"), entry), ",").alias("family_credits"))


_SNAPSHOT = """
snap AS (SELECT snapshot_id, any_value(global_champion.candidate_id) AS champion, max(len(coalesce(audit_queue, []))) AS audits, max(len(coalesce(invalid_fast_candidates, []))) AS fast,
  bool_or(coalesce(frame_break_required, false)) AS broken, max(pending_expansion) AS expansion FROM frontier GROUP BY 1),
busy AS (SELECT snapshot_id, count(*) FILTER (WHERE {st} = 'leased') AS leased FROM (SELECT snapshot_id, unnest(map_entries(workers)) AS e FROM (SELECT DISTINCT * FROM workers)) GROUP BY 1)""".format(st=sql_folded("e.value.status"))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot once, with the leased workers of the same number."""
    n = lambda c: F.max(F.size(F.coalesce(c, F.array().cast("array<string>"))))
    snap = table(spark, d, "frontier").groupBy("snapshot_id").agg(F.first("global_champion.candidate_id", ignorenulls=True).alias("champion"), n("audit_queue").cast("long").alias("audits"), n("invalid_fast_candidates").cast("long").alias("fast"), F.bool_or(F.coalesce("frame_break_required", F.lit(False))).alias("broken"), F.max("pending_expansion").alias("expansion"))
    busy = table(spark, d, "workers").select("snapshot_id", F.explode("workers").alias("worker", "w"), F.xxhash64("updated_at", F.map_keys("workers"), F.map_values("workers")).alias("h"))
    busy = busy.dropDuplicates(["snapshot_id", "worker", "h"]).groupBy(F.col("snapshot_id").alias("_s")).agg(F.count_if(folded("w.status") == "leased").alias("leased"))
    return snap.join(busy, F.col("snapshot_id") == F.col("_s"), "left").drop("_s").withColumn("leased", F.coalesce("leased", F.lit(0)))


@query(f"""WITH {_FUNDING}, {_SNAPSHOT}, left_ AS (SELECT snapshot_id, sum(probes) AS probes FROM per GROUP BY 1)
SELECT snapshot_id, CASE WHEN snapshot_id % 12 = 0 THEN 'checkpoint' WHEN coalesce(expansion, '') <> '' THEN 'expansion' WHEN audits > 0 OR fast > 0 THEN 'audit' WHEN coalesce(leased, 0) > 0 THEN 'supervisor'
  WHEN broken AND coalesce(probes, 0) <= 0 THEN 'frame_break' ELSE 'supervisor' END AS phase FROM snap LEFT JOIN busy USING (snapshot_id) LEFT JOIN left_ USING (snapshot_id)""")
def snapshot_phase(spark: SparkSession, d: str) -> DataFrame:
    """What follows from each snapshot of the frontier: its own expansion, audits, leases, flag and probes left."""
    snap = _snapshots(spark, d).join(probes_left(spark, d), "snapshot_id", "left")
    stuck = state.plateaued(F.col("broken"), F.lit(0), 6) & (F.coalesce("remaining_cheap_probes", F.lit(0)) <= 0)
    phase = state.phase(F.lit(True), F.lit(True), F.col("snapshot_id"), 12, F.coalesce("expansion", F.lit("")) != "", F.col("audits") + F.col("fast"), F.col("leased"), stuck)
    return snap.select("snapshot_id", phase.alias("phase"))


@query(f"""WITH {_FUNDING}, {_SNAPSHOT}, maps AS (SELECT snapshot_id, sum(credits) AS credits, count(*) AS n FROM per GROUP BY 1)
SELECT snapshot_id AS step_count, champion AS global_champion, audits AS n_audit, coalesce(leased, 0) AS leased_jobs, CAST(coalesce(credits, 0) AS BIGINT) AS credits, coalesce(n, 0) AS n_families
FROM snap LEFT JOIN busy USING (snapshot_id) LEFT JOIN maps USING (snapshot_id) WHERE snapshot_id % 6 = 0""")
def checkpoint_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Counts, champion and credits at every sixth step."""
    credits = _funding(spark, d).groupBy("snapshot_id").agg(F.sum("credits").alias("credits"), F.count(F.lit(1)).alias("n"))
    snap = _snapshots(spark, d).where("snapshot_id % 6 = 0").join(credits, "snapshot_id", "left")
    return snap.select(F.col("snapshot_id").alias("step_count"), F.col("champion").alias("global_champion"), F.col("audits").alias("n_audit"), F.col("leased").alias("leased_jobs"), F.coalesce("credits", F.lit(0)).alias("credits"), F.coalesce("n", F.lit(0)).alias("n_families"))


@query(f"""WITH {_CURRENT}, {_FUNDING}, {_SNAPSHOT}, last_ AS (SELECT max(snapshot_id) AS s FROM snap)
SELECT (SELECT count(*) FROM cur) AS total_candidates, (SELECT count(*) FROM cur WHERE st IN ('queued', 'running', 'evaluating')) AS pending_candidates, champion AS global_champion, audits AS n_audit, coalesce(leased, 0) AS worker_leases,
  (SELECT CAST(coalesce(sum(probes), 0) AS BIGINT) FROM per, last_ WHERE snapshot_id = s) AS remaining_cheap_probes, (SELECT count(*) FROM per, last_ WHERE snapshot_id = s) AS n_families
FROM snap LEFT JOIN busy USING (snapshot_id), last_ WHERE snapshot_id = s""")
def lab_summary(spark: SparkSession, d: str) -> DataFrame:
    """Where the lab stands at its last snapshot: candidates of the log, champion, audits, leases and probes left. One row."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    counts = _current(spark, d).agg(F.count(F.lit(1)).alias("total_candidates"), F.count_if(F.col("status").isin(*state.PENDING)).alias("pending_candidates"))
    last = _snapshots(spark, d).agg(F.max_by(F.struct(F.col("champion").alias("global_champion"), F.col("audits").alias("n_audit"), F.col("leased").alias("worker_leases")), "snapshot_id").alias("x"), F.max("snapshot_id").alias("s")).select("x.*", "s")
    fund = _funding(spark, d).groupBy("snapshot_id").agg(F.sum("probes").alias("remaining_cheap_probes"), F.count(F.lit(1)).alias("n_families"))
    last = last.join(fund, F.col("s") == F.col("snapshot_id"), "left").select("global_champion", "n_audit", "worker_leases", F.coalesce("remaining_cheap_probes", F.lit(0)).alias("remaining_cheap_probes"), F.coalesce("n_families", F.lit(0)).alias("n_families"))
    names = ["global_champion", "n_audit", "worker_leases", "remaining_cheap_probes", "n_families"]
    a = counts.select("total_candidates", "pending_candidates", none("global_champion", "string"), *[none(c, "bigint") for c in names[1:]])
    b = last.select(none("total_candidates", "bigint"), none("pending_candidates", "bigint"), *names)
    both = a.unionByName(b)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query(f"WITH {_FUNDING} SELECT snapshot_id, family, plateau FROM per WHERE plateau >= 2")
def plateaued_families(spark: SparkSession, d: str) -> DataFrame:
    """The families of each snapshot that are stuck: two rejections or more since their last promotion."""
    return _funding(spark, d).where("plateau >= 2").select("snapshot_id", "family", "plateau")


@query(f"""WITH {_FUNDING}, pick AS (SELECT snapshot_id, family, plateau >= 4 AS stuck, bool_or(plateau >= 4) OVER (PARTITION BY snapshot_id) AS any_stuck, row_number() OVER (PARTITION BY snapshot_id ORDER BY family) AS k FROM per)
SELECT snapshot_id, family FROM pick WHERE stuck OR (NOT any_stuck AND k <= 2)""")
def scouted_families(spark: SparkSession, d: str) -> DataFrame:
    """The stuck families of each snapshot; where none is, its first two."""
    w = W.partitionBy("snapshot_id")
    f = _funding(spark, d).withColumn("stuck", F.col("plateau") >= 4).withColumn("any", F.bool_or("stuck").over(w)).withColumn("k", F.row_number().over(w.orderBy("family")))
    return f.where(F.col("stuck") | (~F.col("any") & (F.col("k") <= 2))).select("snapshot_id", "family")


# --- joins and unions of branches -----------------------------------------------------------------------------------------


@query("""SELECT n_name AS branch, coalesce(b.n, 0) AS budget, coalesce(c.n, 0) AS n_experiments FROM nation
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON b.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) c ON c.k = n_nationkey""")
def beliefs_with_budget(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each branch with its budget, 0 where it has none."""
    counted = lambda df, c, n: df.groupBy(F.col(c).alias(f"k_{n}")).agg(F.count(F.lit(1)).alias(n))
    budget = counted(table(spark, d, "supplier"), "s_nationkey", "budget")
    runs = counted(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_nationkey", "runs")
    both = table(spark, d, "nation").join(budget, F.col("n_nationkey") == F.col("k_budget"), "left").join(runs, F.col("n_nationkey") == F.col("k_runs"), "left")
    return both.select(F.col("n_name").alias("branch"), F.coalesce("budget", F.lit(0)).alias("budget"), F.coalesce("runs", F.lit(0)).alias("n_experiments"))


@query("""WITH b AS (SELECT n_nationkey AS k, n_name AS branch, CASE WHEN n_name = 'CHINA' THEN 2 WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END AS kind FROM nation)
SELECT CAST(row_number() OVER (ORDER BY kind, k) AS BIGINT) AS place, branch, coalesce(bel.n, 0) AS n_experiments, coalesce(bud.n, 0) AS budget, ch.champion FROM b
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) bel USING (k) LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) bud USING (k)
LEFT JOIN (SELECT s_nationkey AS k, arg_max(s_name, s_acctbal) AS champion FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ch USING (k)""")
def branch_overview(spark: SparkSession, d: str) -> DataFrame:
    """Branches with beliefs, budget and champion, the ordinary ones first, then those about the method, then the capstone."""
    s = table(spark, d, "supplier")
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("branch"))
    last, meta = F.col("branch") == "CHINA", F.col("k") % 4 == 0
    lists = [b.where(~last & ~meta).withColumn("kind", F.lit(0)), b.where(~last & meta).withColumn("kind", F.lit(1)), b.where(last).withColumn("kind", F.lit(2))]
    union = lists[0].unionByName(lists[1]).unionByName(lists[2])
    for df in (
        table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_experiments")),
        s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("budget")),
        s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.max_by("s_name", "s_acctbal").alias("champion")),
    ):
        union = union.join(df, "k", "left")
    # a row for each branch of a configuration
    place = F.row_number().over(W.orderBy("kind", "k")).cast("long")
    return union.select(place.alias("place"), "branch", F.coalesce("n_experiments", F.lit(0)).alias("n_experiments"), F.coalesce("budget", F.lit(0)).alias("budget"), "champion")


@query(_with(("points",), """,
dom AS (SELECT a.candidate_id AS lo, b.candidate_id AS hi FROM points a JOIN points b ON b.gain >= a.gain AND b.thrift >= a.thrift AND (b.gain > a.gain OR b.thrift > a.thrift)),
lay AS (SELECT candidate_id, CAST(0 AS BIGINT) AS layer FROM points UNION SELECT dom.lo, lay.layer + 1 FROM lay JOIN dom ON dom.hi = lay.candidate_id),
top AS (SELECT candidate_id, max(layer) AS layer FROM lay GROUP BY candidate_id)
SELECT layer, string_agg(c, ',' ORDER BY c) AS front FROM (SELECT layer, CAST(candidate_id AS VARCHAR) AS c FROM top) GROUP BY layer""", True))
def sorted_fronts(spark: SparkSession, d: str) -> DataFrame:
    """Each layer's candidates in the order of their names. A layer is a row of a report here; layers of any size stay as rows in
    pareto_rank."""
    ranked = pareto.layers(view(spark, d, "points"), "candidate_id", ["gain", "thrift"])
    return ranked.groupBy("layer").agg(F.array_join(F.array_sort(F.collect_list(F.col("candidate_id").cast("string"))), ",").alias("front"))


@query(_with(("branches",), " SELECT branch FROM branches WHERE status NOT IN ('exhausted', 'converged') AND budget > 0 QUALIFY row_number() OVER (ORDER BY 84 - last_explored_cycle >= 10 AND status = 'active' DESC, CASE WHEN 84 - last_explored_cycle >= 10 AND status = 'active' THEN branch END, round(0.3 * current_ev + 0.4 / sqrt(1 + n_experiments) + 0.3 * least(1.0, (84 - last_explored_cycle) / 3.0), 6) DESC, n_experiments, budget DESC, branch) <= 2"))
def branch_rank_limited(spark: SparkSession, d: str) -> DataFrame:
    """No more than the first two branches of the ranking."""
    return detectors.branch_priority(view(spark, d, "branches"), 84).orderBy("place").limit(2).select("branch")


@query("""WITH ch AS (SELECT c_nationkey AS f, arg_max(c_custkey, c_acctbal) AS c FROM customer WHERE c_nationkey % 3 <> 1 GROUP BY 1), g AS (SELECT arg_max(c_custkey, c_acctbal) AS g FROM customer WHERE c_nationkey % 3 <> 1)
SELECT CAST(n_nationkey AS BIGINT) AS family, coalesce(CAST(coalesce(c, g) AS VARCHAR), 'base') AS parent FROM nation LEFT JOIN ch ON f = n_nationkey, g""")
def mutation_parents(spark: SparkSession, d: str) -> DataFrame:
    """The parent of a family's next mutation: its champion, else the global one, else the baseline."""
    cust = table(spark, d, "customer").where("c_nationkey % 3 <> 1")
    families = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("family"))
    own = cust.groupBy(F.col("c_nationkey").cast("long").alias("family")).agg(F.max_by("c_custkey", "c_acctbal").alias("champion"))
    best = cust.agg(F.max_by("c_custkey", "c_acctbal").alias("champion"))
    return queueing.mutation_parents(families, own, best, "base")


# --- credits, effects and leases ------------------------------------------------------------------------------------------


@query(f"""WITH cur AS (SELECT id, stability, op, n_wins, st FROM (SELECT {sql_folded('candidate_id')} AS id, stability, {sql_folded('operator_type')} AS op, len(coalesce(parent_ids, [])) AS n_wins, {sql_folded('status')} AS st,
  row_number() OVER (PARTITION BY {sql_folded('candidate_id')} ORDER BY seq DESC) AS n FROM candidates WHERE coalesce({sql_folded('candidate_id')}, '') <> '') WHERE n = 1)
SELECT id AS candidate_id, CAST(3 + CASE WHEN stability.stable THEN 1 ELSE 0 END + CASE WHEN op IN ('crossover', 'frame_break_spawn') THEN 1 ELSE 0 END + 2 * n_wins AS BIGINT) AS minted FROM cur WHERE st = 'promoted'""")
def minted_credits(spark: SparkSession, d: str) -> DataFrame:
    """What each promotion mints: for itself, for a stable score, for a new kind of operator and for each decisive win (here the
    parents stand in for the wins, which the log doesn't hold)."""
    c = table(spark, d, "candidates").where(present("candidate_id"))
    cur = c.groupBy(folded("candidate_id").alias("candidate_id")).agg(F.max_by(F.struct("stability", folded("operator_type").alias("op"), F.size(F.coalesce("parent_ids", F.array().cast("array<string>"))).alias("wins"), folded("status").alias("status")), "seq").alias("x")).select("candidate_id", "x.*")
    return cur.where("status = 'promoted'").select("candidate_id", queueing.minted(F.col("stability.stable"), F.col("op"), F.col("wins"), lab.CREDITS).alias("minted"))


@query(_with(("runs",), _FOLD + """,
dec AS (SELECT candidate_id, family, CASE WHEN p AND runs < 2 THEN 'evaluating' WHEN NOT all_valid AND mean_search > coalesce(c, -1e300) + 1.0 THEN 'invalidated' WHEN p AND s THEN 'promoted' WHEN p THEN 'unstable' ELSE 'rejected' END AS d, runs, s
  FROM (SELECT agg.candidate_id, agg.family, runs, mean_search, all_valid, f.champion_before AS c, all_valid AND (f.champion_before IS NULL OR mean_selection > f.champion_before + 1.0) AS p, coalesce(relative_std <= 1.0, true) AS s FROM agg JOIN fold f USING (candidate_id)))
SELECT candidate_id, 'requeue' AS effect, CAST(runs + 1 AS BIGINT) AS amount FROM dec WHERE d = 'evaluating' UNION ALL SELECT candidate_id, 'audit', 1 FROM dec WHERE d IN ('invalidated', 'unstable')
UNION ALL SELECT candidate_id, 'plateau', 1 FROM dec WHERE d = 'rejected' UNION ALL SELECT candidate_id, 'mint', 4 FROM dec WHERE d = 'promoted'""", True))
def completion_effects(spark: SparkSession, d: str) -> DataFrame:
    """What each decision changes: another attempt in the queue, an entry of the audit, a step of the plateau counter or
    credits minted. One row for each effect."""
    c = F.col("champion_before")
    better = F.col("all_valid") & (c.isNull() | (F.col("mean_selection") > c + 1.0))
    fast = ~F.col("all_valid") & (F.col("mean_search") > F.coalesce(c, F.lit(-1e300)) + 1.0)
    one = lambda name, amount: F.struct(F.lit(name).alias("effect"), amount.cast("long").alias("amount"))
    effect = F.when(better & (F.col("runs") < 2), one("requeue", F.col("runs") + 1)).when(fast | (better & ~F.col("stable")), one("audit", F.lit(1))).when(better, one("mint", F.lit(4))).otherwise(one("plateau", F.lit(1)))
    return _folded_runs(spark, d).select("candidate_id", effect.alias("x")).select("candidate_id", "x.*")


@query(f"""WITH late AS (SELECT DISTINCT snapshot_id, e.key AS worker, e.value.current_job_id AS job_id, updated_at FROM (SELECT snapshot_id, updated_at, unnest(map_entries(workers)) AS e FROM workers)
WHERE {sql_folded('e.value.status')} = 'leased' AND (epoch_us(updated_at) - epoch_us(e.value.leased_at)) / 1e6 > coalesce(e.value.lease_timeout_seconds, 1800))
SELECT snapshot_id, worker, job_id, 'queued' AS job_status, 'idle' AS worker_status, epoch_us(updated_at) AS queued_us FROM late""")
def requeued_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The jobs whose lease has run out, back in the queue as of the snapshot, and their workers idle; repeated snapshots count once."""
    slots = table(spark, d, "workers").select("snapshot_id", "updated_at", F.explode("workers").alias("worker", "w"))
    age = (F.unix_micros("updated_at") - F.unix_micros("w.leased_at")) / 1e6
    late = slots.where((folded("w.status") == "leased") & (age > F.coalesce("w.lease_timeout_seconds", F.lit(lab.LEASE_SECONDS))))
    return late.select("snapshot_id", "worker", F.col("w.current_job_id").alias("job_id"), F.lit("queued").alias("job_status"), F.lit("idle").alias("worker_status"), F.unix_micros("updated_at").alias("queued_us")).distinct()


# --- runs -----------------------------------------------------------------------------------------------------------------


def _product(doc: dict) -> dict:
    """A runner: the score of a size and a depth; a depth of 0 crashes."""
    score = doc["size"] / doc["depth"]
    return {"metrics": {"search": {"primary_metric": score}}, "finding": f"depth {doc['depth']}"}


@query("""SELECT CAST(p_partkey AS VARCHAR) AS candidate_id, p_size % 6 > 0 AS valid, CASE WHEN p_size % 6 = 0 THEN 0.0 ELSE p_size / CAST(p_size % 6 AS DOUBLE) END AS search, CASE WHEN p_size % 6 = 0 THEN 'division by zero' END AS error FROM part""")
def runner_results(spark: SparkSession, d: str) -> DataFrame:
    """2.N, K8: a runner over candidate documents; those that crash come out as invalid results with the error's text."""
    docs = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), F.format_string('{"size": %d, "depth": %d}', "p_size", F.col("p_size") % 6).alias("document"))
    out = runner.run(docs, _product)
    return out.select("candidate_id", "valid", metrics.number_at("result", "metrics.search.primary_metric").alias("search"), "error")


_RUNS = """c AS (SELECT p_partkey AS candidate_id, 100 AS steps, 20 AS every, p_size % 8 AS depth, 32 + 16 * (p_partkey % 3) AS d_model, CASE p_partkey % 4 WHEN 0 THEN 0.2 ELSE 0.05 END AS dropout, p_partkey % 3 * 30 AS warmup,
  CASE p_partkey % 5 WHEN 0 THEN 0.015 ELSE 0.003 END AS lr, least(1.0, p_retailprice / 2500.0) AS score FROM part)"""


@query(f"""WITH {_RUNS}, k AS (SELECT *, CASE WHEN depth >= 6 AND d_model <= 48 THEN 75 WHEN lr > 0.008 AND warmup < 5 THEN 12 END AS collapse FROM c),
s AS (SELECT k.*, step, greatest(0.0, least(1.0, score * (1 - exp(-3.0 * step / steps)) - 0.05 * CASE WHEN warmup > 0 THEN greatest(0.0, 1 - CAST(step AS DOUBLE) / warmup) ELSE 0.0 END)) AS v FROM k, (SELECT unnest(range(20, 101, 20)) AS step) WHERE collapse IS NULL OR step - 20 < collapse)
SELECT CAST(candidate_id AS VARCHAR) AS candidate_id, step, CASE WHEN coalesce(step >= collapse, false) THEN 0.0 WHEN dropout > 0.1 THEN round(greatest(0.0, round(v, 6) - dropout * 0.3), 6) ELSE round(v, 6) END AS search_eval,
  CASE WHEN NOT coalesce(step >= collapse, false) THEN round(greatest(0.01, 2.5 * (1 - v)), 6) END AS loss, NOT coalesce(step >= collapse, false) AS valid FROM s""")
def synthetic_runs(spark: SparkSession, d: str) -> DataFrame:
    """Made-up runs, here without noise so that SQL can say them too."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    c = p.select(k.cast("string").alias("candidate_id"), F.lit(100).alias("steps"), F.lit(20).alias("every"), (F.col("p_size") % 8).alias("depth"), (32 + 16 * (k % 3)).alias("d_model"), F.when(k % 4 == 0, 0.2).otherwise(0.05).alias("dropout"), (k % 3 * 30).alias("warmup"), F.when(k % 5 == 0, 0.015).otherwise(0.003).alias("lr"), F.least(F.lit(1.0), F.col("p_retailprice") / 2500.0).alias("score"))
    return runner.trajectories(c, noise=0.0, spread=False)


@query(_with(("series",), """,
p AS (SELECT candidate_id, coalesce(bool_or(valid = false AND i >= n // 2), false) AS collapsed, arg_max(coalesce(valid, false), pos) AS ok FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY candidate_id) AS n FROM series) GROUP BY 1)
SELECT candidate_id, CASE WHEN collapsed THEN 'unstable' WHEN NOT ok THEN 'other' END AS failure_class FROM p"""))
def failure_with_trend(spark: SparkSession, d: str) -> DataFrame:
    """The class of runs without an error text: unstable where their trend collapsed, else told by their flag."""
    series = view(spark, d, "series")
    trend = ordered.thirds_trend(series, "candidate_id", "pos", "search_eval", "valid", "step").select("candidate_id", "trend")
    last = series.groupBy("candidate_id").agg(F.max_by(F.coalesce("valid", F.lit(False)), "pos").alias("ok"))
    none = F.lit(None).cast("string")
    return trend.join(last, "candidate_id").select("candidate_id", metrics.failure_class(none, F.col("ok"), F.lit("{}"), F.col("trend")).alias("failure_class"))


@query(_with(("experiments",), """ SELECT seq, CASE WHEN seq % 7 = 0 THEN 'crashed' WHEN seq % 7 = 1 THEN NULL WHEN seq % 7 = 2 THEN 'other' WHEN seq % 7 = 3 THEN 'marginal' ELSE CASE WHEN starts_with(reason, 'score=') THEN 'soft_below_champion' ELSE 'rejected_other' END END AS failure_type FROM experiments"""))
def failure_types(spark: SparkSession, d: str) -> DataFrame:
    """The failure type of every verdict, crashes, diagnostics and unknown ones too."""
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("RUNTIME error", "DIAGNOSTIC", "TIMEOUT", "MARGINAL", "REJECT", "REJECT", "REJECT")]), (F.col("seq") % 7 + 1).cast("int"))
    return view(spark, d, "experiments").select("seq", metrics.failure_type(verdict, F.array().cast("array<string>"), F.col("reason")).alias("failure_type"))


# --- time -----------------------------------------------------------------------------------------------------------------


@query(_with(("experiments",), """, e AS (SELECT min(cycle) AS a, max(cycle) + 1 AS b FROM experiments),
w AS (SELECT k AS fold, a + 12 * k AS t0, a + 24 + 12 * k AS t1, a + 25 + 12 * k AS c0, a + 31 + 12 * k AS c1 FROM (SELECT unnest(range(0, 100)) AS k), e WHERE a + 31 + 12 * k <= b)
SELECT fold, round(avg(composite_score) FILTER (WHERE cycle >= t0 AND cycle < t1), 6) AS train_mean, round(avg(composite_score) FILTER (WHERE cycle >= c0 AND cycle < c1), 6) AS test_mean FROM w, experiments GROUP BY fold"""))
def rolling_windows(spark: SparkSession, d: str) -> DataFrame:
    """F16: walk-forward windows of a fixed length that roll on, with a dead zone before each test window."""
    runs = view(spark, d, "experiments")
    ends = runs.agg(F.min("cycle").alias("first"), F.max("cycle").alias("last")).first()
    first, last = (0, 0) if ends["first"] is None else (ends["first"], ends["last"] + 1)
    out = temporal.walk_forward_scores(runs, "cycle", "composite_score", temporal.walk_forward(first, last, 24, 6, 12, 1, spark, expanding=False))
    return out.select(F.col("fold").cast("long").alias("fold"), F.round("train_mean", 6).alias("train_mean"), F.round("test_mean", 6).alias("test_mean"))


@query(_with(("experiments",), """ SELECT part, count(*) AS n, round(avg(composite_score), 6) AS mean_score FROM (
SELECT composite_score, CASE WHEN cycle >= 40 AND cycle < 52 THEN 'test' WHEN cycle < 38 OR cycle >= 55 THEN 'train' END AS part FROM experiments) WHERE part IS NOT NULL GROUP BY part"""))
def embargo_split(spark: SparkSession, d: str) -> DataFrame:
    """F16: a test window with what lies shortly before it purged and what comes shortly after under embargo."""
    parts = temporal.embargoed(view(spark, d, "experiments"), "cycle", 40, 52, 2, 3)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("composite_score"), 6).alias("mean_score"))


@query(_with(("experiments",), """, e AS (SELECT min(cycle) AS a, (max(cycle) + 6 - min(cycle)) // 6 AS w FROM experiments), m AS (SELECT unnest(range(0, 64)) AS m), c AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS split FROM m WHERE bit_count(m) = 2),
r AS (SELECT cycle, composite_score AS s, (cycle - a) // w AS g, a, w FROM experiments, e),
x AS (SELECT split, m, s, m & (1 << g) <> 0 AS is_test, EXISTS (SELECT 1 FROM (SELECT unnest(range(0, 6)) AS h) WHERE m & (1 << h) <> 0 AND cycle >= a + h * w - 1 AND cycle < a + (h + 1) * w + 2) AS near FROM r, c)
SELECT split, (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT unnest(range(0, 6)) AS h) WHERE m & (1 << h) <> 0) AS test_groups, count(*) FILTER (WHERE NOT is_test AND NOT near) AS n_train,
  round(avg(s) FILTER (WHERE NOT is_test AND NOT near), 6) AS train_mean, round(avg(s) FILTER (WHERE is_test), 6) AS test_mean FROM x GROUP BY split, m"""))
def combinatorial_splits(spark: SparkSession, d: str) -> DataFrame:
    """F16: every choice of two of six stretches of time as the test, purged and under embargo."""
    out = temporal.purged_combinations(view(spark, d, "experiments"), "cycle", "composite_score", 6, 2, 1, 2)
    return out.select("split", "test_groups", "n_train", F.round("train_mean", 6).alias("train_mean"), F.round("test_mean", 6).alias("test_mean"))
