"""A lab's control plane: its state documents, the decisions on one finished job, and the summaries of both.

Queues, workers, funding and champions are documents of the size of a configuration: they are read, changed and replaced on the driver.
The logs of candidates and evaluations grow; they are tables, appended to and aggregated by Spark. `now` is always a parameter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.functions import metrics
from trialforge.operators import latest
from trialforge.operators.state import PENDING
from trialforge.sources import files

CANDIDATES = """candidate_id string, signature string, family string, operator_type string, parent_ids array<string>, status string,
    resource_class string, config_patch string, proxy_metrics string, search_eval double, selection_eval double, final_eval double,
    stability struct<runs:bigint,stable:boolean,relative_std:double>, resource_floor double, finding string, artifact_dir string,
    created_at timestamp, updated_at timestamp, suspicion string"""
EVALUATIONS = """candidate_id string, attempt bigint, result_path string, evaluated_at timestamp, valid boolean, search_eval double,
    selection_eval double, final_eval double, proxy_metrics string, resource_floor double, finding string, metrics string,
    failure_class string"""

# What a configuration that lacks the key stands for.
CREDITS = {"promote_credit": 3, "stable_credit": 1, "novelty_credit": 1, "prediction_credit": 2, "dispatch_cost": 1}
ARCHIVE = {"global_top_k": 20, "family_top_k": 3}
INITIAL_CREDITS, INTERVAL, WINDOW, LEASE_SECONDS = 6, 12, 6, 1800
POLICY = {"min_reruns_for_promotion": 2, "max_relative_std": 0.05, "suspicious_improvement_margin": 0.02, "invalid_fast_margin": 0.02}
NOVEL = ("crossover", "frame_break_spawn")


def defaults(runtime_cfg: dict) -> dict[str, int]:
    """The credits and archive sizes of a configuration; numbers are cut to integers."""
    archive = runtime_cfg.get("selection", {}).get("elite_archive", {})
    return {k: int(runtime_cfg.get("funding", {}).get(k, v)) for k, v in CREDITS.items()} | {k: int(archive.get(k, v)) for k, v in ARCHIVE.items()}


@dataclass
class Lab:
    """The documents of a lab and where its logs lie."""

    spark: SparkSession
    root: str
    branches: dict = field(default_factory=dict)
    runtime_cfg: dict = field(default_factory=dict)
    evaluation_cfg: dict = field(default_factory=dict)
    runtime: dict = field(default_factory=dict)
    jobs: dict = field(default_factory=dict)
    workers: dict = field(default_factory=dict)
    frontier: dict = field(default_factory=dict)

    @property
    def candidates(self) -> DataFrame:
        return files.read_lines(self.spark, f"{self.root}/state/candidates.jsonl", CANDIDATES)

    @property
    def evaluations(self) -> DataFrame:
        return files.read_lines(self.spark, f"{self.root}/state/evaluations.jsonl", EVALUATIONS)

    @property
    def current(self) -> DataFrame:
        """The last record of each candidate."""
        return latest.latest_record(self.candidates.select("candidate_id", "family", "status", "suspicion", "selection_eval", "seq"), "candidate_id", ["seq"], "seq")


def _document(spark: SparkSession, path: str, default: dict) -> dict:
    text = files.read_text(spark, path)
    return json.loads(text) if text.strip() else default


def empty_frontier() -> dict:
    return {
        "global_champion": None, "family_champions": {}, "elite_archive": {"global": [], "families": {}}, "family_funding": {}, "decisive_challenges": {},
        "audit_queue": [], "invalid_fast_candidates": [], "unstable_candidates": [], "pending_expansion": None, "frame_break_required": False,
    }


def load(spark: SparkSession, root: str) -> Lab:
    """The lab under a folder; files that are missing stand for their empty documents."""
    doc = lambda name, default: _document(spark, f"{root}/state/{name}.json", default)
    cfg = lambda name: files.read_yaml(spark, f"{root}/{name}.yaml", {})
    jobs = {"queued": [], "leased": [], "finished": []}
    return Lab(spark, root, cfg("branches"), cfg("runtime"), cfg("evaluation"), doc("runtime", {}), doc("jobs", jobs), doc("workers", {"workers": {}}), doc("frontier", empty_frontier()))


def load_legacy(spark: SparkSession, root: str) -> tuple[dict[str, dict], DataFrame]:
    """The documents of a lab of the older kind that are there, by name, and its experiment log."""
    names = ("cycle_counter", "branch_beliefs", "champions", "budget")
    docs = {n: _document(spark, f"{root}/state/{n}.json", {}) for n in names if files.exists(spark, f"{root}/state/{n}.json")}
    log = "branch string, verdict string, cycle bigint, composite_score double, champion_score double, delta string, reason string, hard_gate_failures array<string>, elapsed_sec double, tokens_used bigint"
    return docs, files.read_lines(spark, f"{root}/state/experiment_log.jsonl", log)


def save(lab: Lab) -> None:
    """Replaces the state documents, each in one step."""
    for name in ("runtime", "jobs", "workers", "frontier"):
        files.write_text(lab.spark, f"{lab.root}/state/{name}.json", json.dumps(getattr(lab, name), sort_keys=True))


def readiness_issues(lab: Lab) -> list[str]:
    """Which parts of the configuration are missing."""
    wanted = {"branches.families": lab.branches.get("families"), "branches.production_baseline": lab.branches.get("production_baseline"), "evaluation.search": lab.evaluation_cfg.get("search"), "runtime.workers": lab.runtime_cfg.get("workers")}
    return [name for name, part in wanted.items() if not part]


def pool(runtime_cfg: dict) -> dict[str, dict]:
    """Idle workers of each pool, counted from 1; of pools of equal class the last."""
    pools = {p.get("resource_class", "cpu"): p for p in runtime_cfg.get("workers", {}).get("pools", [])}
    return {
        f"{c}-{k}": {"worker_id": f"{c}-{k}", "resource_class": c, "status": "idle", "lease_timeout_seconds": int(p.get("lease_timeout_seconds", LEASE_SECONDS)), "current_job_id": None, "current_candidate_id": None, "leased_at": None}
        for c, p in pools.items()
        for k in range(1, int(p.get("slots", 1)) + 1)
    }


def bootstrap(lab: Lab, now: str) -> Lab:
    """The first state of a lab: funding for each family, idle workers, empty queues and the baseline as the first candidate, which is
    the global champion if it has a selection score (0 counts). Rows of an older log stay."""
    if missing := readiness_issues(lab):
        raise ValueError("not ready: " + ", ".join(missing))
    lab.runtime = {"status": "idle", "active_phase": "supervisor", "created_at": now, "updated_at": now, "stagnation_counter": 0, "step_count": 0, "last_checkpoint_at": None}
    lab.workers, lab.jobs, lab.frontier = {"workers": pool(lab.runtime_cfg)}, {"queued": [], "leased": [], "finished": []}, empty_frontier()
    for name, family in lab.branches["families"].items():
        lab.frontier["family_funding"][name] = {
            "credits": int(family.get("funding", {}).get("initial_credits", family.get("initial_credits", INITIAL_CREDITS))), "spent": 0, "minted": 0,
            "remaining_cheap_probes": len(family.get("cheap_probes", [])), "tried_signatures": [], "queued_signatures": [], "plateau_counter": 0, "status": "active", "exhausted": False,
        }
    base = lab.branches["production_baseline"]
    seed = base.get("seed_metrics", {})
    row = {"candidate_id": base.get("experiment_id", "baseline"), "family": "baseline", "operator_type": "baseline", "status": "promoted", "created_at": now, "updated_at": now, "finding": base.get("description"), **{k: seed.get(k) for k in ("search_eval", "selection_eval", "final_eval")}}
    _append(lab, "candidates", CANDIDATES, row)
    if row["selection_eval"] is not None:
        lab.frontier["global_champion"] = {k: row[k] for k in ("candidate_id", "family", "selection_eval", "search_eval")}
    save(lab)
    return lab


def _append(lab: Lab, log: str, schema: str, row: dict) -> None:
    one = lab.spark.createDataFrame([json.dumps({k: v for k, v in row.items() if v is not None})], "string").select(F.from_json("value", schema).alias("x")).select("x.*")
    files.append_lines(one, f"{lab.root}/state/{log}.jsonl")


def dispatch(lab: Lab, specs: list[dict], now: str) -> list[dict]:
    """Queues the candidates of specs (candidate_id, signature, family, operator_type, parent_ids, config_patch) whose families can pay."""
    made, cost = [], defaults(lab.runtime_cfg)["dispatch_cost"]
    for spec in specs:
        fund = lab.frontier["family_funding"].get(spec["family"])
        if fund is None or fund["exhausted"] or fund["credits"] < cost:
            continue
        fund["credits"], fund["spent"] = fund["credits"] - cost, fund["spent"] + cost
        fund["queued_signatures"].append(spec["signature"])
        resource = lab.branches["families"][spec["family"]].get("resource_class", "cpu")
        job = {"job_id": f"job_{spec['candidate_id']}_1", "candidate_id": spec["candidate_id"], "family": spec["family"], "resource_class": resource, "attempt": 1, "status": "queued", "queued_at": now}
        _append(lab, "candidates", CANDIDATES, spec | {"status": "queued", "resource_class": resource, "created_at": now, "updated_at": now, "config_patch": json.dumps(spec.get("config_patch", {}))})
        lab.jobs["queued"].append(job)
        made.append(job)
    save(lab)
    return made


def lease(lab: Lab, worker_id: str, now: str) -> dict | None:
    """The worker's next job: of its class, the fewest attempts and the longest wait first; None if there is none or it is busy."""
    worker = lab.workers["workers"][worker_id]
    fit = sorted(((j["attempt"], j["queued_at"], k) for k, j in enumerate(lab.jobs["queued"]) if j["resource_class"] == worker["resource_class"]))
    if worker["status"] != "idle" or not fit:
        return None
    job = lab.jobs["queued"].pop(fit[0][2])
    job |= {"status": "leased", "worker_id": worker_id, "leased_at": now}
    lab.jobs["leased"].append(job)
    worker |= {"status": "leased", "current_job_id": job["job_id"], "current_candidate_id": job["candidate_id"], "leased_at": now}
    save(lab)
    return job


def evaluated(results: DataFrame, evaluation_cfg: dict) -> DataFrame:
    """The scores, validity and failure class of result documents (candidate_id, attempt, result): compiled from the configuration."""
    doc = F.get_json_object("result", "$.metrics")
    whole = lambda spec: {**spec, **({"path": f"metrics.{spec['path']}"} if spec.get("path") else {})}
    score = {k: metrics.scored("result", whole(evaluation_cfg.get(k, {"enabled": False}))) for k in ("search", "selection", "final")}
    flag = F.get_json_object("result", "$.valid")
    valid = F.coalesce(flag.cast("boolean"), F.lit(True)) & (metrics.error_text(doc) == "")
    given = F.get_json_object("result", "$.failure_class")
    return results.select(
        "candidate_id", "attempt", valid.alias("valid"), score["search"].alias("search_eval"), F.coalesce(score["selection"], score["search"]).alias("selection_eval"), score["final"].alias("final_eval"),
        F.get_json_object("result", "$.finding").alias("finding"), doc.alias("metrics"), metrics.failure_class(given, valid, doc, F.lit(None).cast("string")).alias("failure_class"),
    )


def decide(stats: dict, champion: dict | None, policy: dict) -> tuple[str, str | None]:
    """What becomes of a candidate with all its attempts so far, and the suspicion that sends it to the audit.

    A champion's score of exactly 0 counts as none, as in the logs that this follows.
    """
    bar = lambda k: (champion or {}).get(k) or float("-inf")
    better = stats["mean_selection"] is not None and stats["all_valid"] and stats["mean_selection"] > bar("selection_eval") + policy["suspicious_improvement_margin"]
    if better and stats["runs"] < policy["min_reruns_for_promotion"]:
        return "evaluating", None
    if not stats["all_valid"] and stats["mean_search"] is not None and stats["mean_search"] > bar("search_eval") + policy["invalid_fast_margin"]:
        return "invalidated", "invalid_fast"
    if better:
        return ("promoted", None) if stats["stable"] else ("rejected", "unstable_frontier")
    return "rejected", None


def complete(lab: Lab, candidate_id: str, result: dict, now: str, worker_id: str | None = None) -> dict:
    """Takes a result in: appends the evaluation, aggregates all attempts of the candidate by Spark, decides, and brings queues,
    workers, funding, champions, archives, audits and the candidate's record to the state that follows."""
    job = next((j for j in lab.jobs["leased"] if j["candidate_id"] == candidate_id and worker_id in (None, j.get("worker_id"))), None)
    if job is None:
        raise LookupError(f"no leased job for {candidate_id}")
    spark, policy = lab.spark, POLICY | lab.evaluation_cfg.get("rerun_policy", {})
    one = evaluated(spark.createDataFrame([(candidate_id, job["attempt"], json.dumps(result))], "candidate_id string, attempt bigint, result string"), lab.evaluation_cfg)
    files.append_lines(one.withColumn("evaluated_at", F.lit(now)), f"{lab.root}/state/evaluations.jsonl")
    own = lab.evaluations.where(F.col("candidate_id") == candidate_id)
    stats = latest.run_statistics(own, "candidate_id", policy["max_relative_std"]).first().asDict()
    record = lab.candidates.where(F.col("candidate_id") == candidate_id).orderBy(F.col("seq").desc()).first()
    family = job["family"]
    status, suspicion = decide(stats, lab.frontier["family_champions"].get(family), policy)

    fund = lab.frontier["family_funding"][family]
    signature = record["signature"]
    fund["queued_signatures"] = [x for x in fund["queued_signatures"] if x != signature]
    fund["tried_signatures"] = list(dict.fromkeys([*fund["tried_signatures"], *([signature] if signature else [])]))
    lab.jobs["leased"] = [j for j in lab.jobs["leased"] if j["job_id"] != job["job_id"]]
    lab.jobs["finished"].append(job | {"status": "finished", "finished_at": now})
    if status == "evaluating":
        attempt = job["attempt"] + 1
        lab.jobs["queued"].append({k: job[k] for k in ("candidate_id", "family", "resource_class")} | {"job_id": f"job_{candidate_id}_{attempt}", "attempt": attempt, "status": "queued", "queued_at": now})
    if job.get("worker_id") in lab.workers["workers"]:
        lab.workers["workers"][job["worker_id"]] |= {"status": "idle", "current_job_id": None, "current_candidate_id": None, "leased_at": None}
    if suspicion:
        lists = ("audit_queue", "invalid_fast_candidates" if suspicion == "invalid_fast" else "unstable_candidates")
        for name in lists:
            lab.frontier[name] = list(dict.fromkeys([*lab.frontier[name], candidate_id]))
    row = {"candidate_id": candidate_id, "family": family, "selection_eval": stats["mean_selection"], "search_eval": stats["mean_search"], "operator_type": record["operator_type"]}
    if status == "promoted":
        _promote(lab, row, own, stats["stable"])
    elif status == "rejected" and not suspicion:
        fund["plateau_counter"] += 1
    stability = {"runs": stats["runs"], "stable": stats["stable"], "relative_std": stats["relative_std"]}
    kept = {k: record[k] for k in ("signature", "parent_ids", "resource_class", "config_patch", "artifact_dir")}
    _append(lab, "candidates", CANDIDATES, row | kept | {"status": status, "suspicion": suspicion, "stability": stability, "created_at": str(record["created_at"]), "updated_at": now, "finding": result.get("finding") or record["finding"]})
    lab.runtime |= {"step_count": lab.runtime.get("step_count", 0) + 1, "updated_at": now, "status": "idle", "active_phase": "supervisor"}
    window = lab.branches["families"][family].get("frame_break", {}).get("plateau_window", lab.runtime_cfg.get("plateau", {}).get("window", WINDOW))
    if fund["plateau_counter"] >= window and not lab.jobs["queued"] and not lab.jobs["leased"]:
        lab.frontier["frame_break_required"] = True
        lab.runtime |= {"active_phase": "frame_break_needed", "stagnation_counter": lab.runtime.get("stagnation_counter", 0) + 1}
    save(lab)
    every = lab.runtime_cfg.get("checkpoint_interval", INTERVAL)
    if every > 0 and lab.runtime["step_count"] % every == 0:
        files.append_lines(summary(lab), f"{lab.root}/state/checkpoints.jsonl")
        lab.runtime["last_checkpoint_at"] = now
        save(lab)
    return row | {"status": status, "suspicion": suspicion}


def _promote(lab: Lab, row: dict, own: DataFrame, stable: bool) -> None:
    """Champions, archives, challenges and credits after a promotion."""
    known, front = defaults(lab.runtime_cfg), lab.frontier
    score = lambda x: x["selection_eval"] or float("-inf")
    front["family_champions"][row["family"]] = row
    if front["global_champion"] is None or score(row) > score(front["global_champion"]):
        front["global_champion"] = row
    shelves = [(front["elite_archive"]["global"], known["global_top_k"]), (front["elite_archive"]["families"].setdefault(row["family"], []), known["family_top_k"])]
    for shelf, most in shelves:
        shelf.append(row)
        shelf.sort(key=score, reverse=True)
        del shelf[most:]
    tests = lab.evaluation_cfg.get("prediction_tests", [])
    wins = 0
    if tests:
        mean = own.select(F.explode(metrics.prediction_tests("metrics", tests)).alias("test", "x")).groupBy("test").agg(F.avg("x.score").alias("score"), F.bool_or("x.decisive").alias("decisive"))
        for r in mean.where("decisive and score is not null").collect():  # a row for each test of the configuration
            leader = front["decisive_challenges"].get(r["test"], {}).get("score") or float("-inf")
            if r["score"] > leader:
                front["decisive_challenges"][r["test"]], wins = {"candidate_id": row["candidate_id"], "score": r["score"]}, wins + 1
    fund = front["family_funding"][row["family"]]
    minted = minted_credits(stable, row["operator_type"], wins, known)
    fund |= {"credits": fund["credits"] + minted, "minted": fund["minted"] + minted, "plateau_counter": 0}


def minted_credits(stable: bool, operator: str, wins: int, known: dict) -> int:
    return known["promote_credit"] + stable * known["stable_credit"] + (operator in NOVEL) * known["novelty_credit"] + wins * known["prediction_credit"]


def reap(lab: Lab, now_epoch: float, now: str, epoch) -> list[str]:
    """Puts jobs whose lease has run out back into the queue, with the same attempt, and frees their workers; `epoch` reads a time."""
    out = []
    for job in list(lab.jobs["leased"]):
        worker = lab.workers["workers"].get(job.get("worker_id"))
        if now_epoch - epoch(job["leased_at"]) > (worker or {}).get("lease_timeout_seconds", LEASE_SECONDS):
            lab.jobs["leased"].remove(job)
            lab.jobs["queued"].append({k: v for k, v in job.items() if k not in ("worker_id", "leased_at")} | {"status": "queued", "queued_at": now})
            if worker:
                worker |= {"status": "idle", "current_job_id": None, "current_candidate_id": None, "leased_at": None}
            out.append(job["job_id"])
    save(lab)
    return out


def next_phase(lab: Lab, pending: int, invalid_fast: int) -> str:
    """What the lab does next; pending and invalid_fast are counts over the candidates' last records."""
    if readiness_issues(lab):
        return "design"
    step, every = lab.runtime.get("step_count") or 0, lab.runtime_cfg.get("checkpoint_interval", INTERVAL)
    front = lab.frontier
    flagged = lab.runtime.get("active_phase") == "frame_break_needed" or front.get("frame_break_required")
    plateaued = flagged or (lab.runtime.get("stagnation_counter") or 0) >= lab.runtime_cfg.get("plateau", {}).get("window", WINDOW)
    rules = (
        ("supervisor", not lab.runtime),
        ("checkpoint", step > 0 and every > 0 and step % every == 0),
        ("expansion", front.get("pending_expansion")),
        ("audit", front.get("audit_queue") or front.get("invalid_fast_candidates") or invalid_fast),
        ("supervisor", lab.jobs["queued"] or lab.jobs["leased"] or pending),
        ("frame_break", plateaued and probes_left(lab) <= 0),
    )
    return next((phase for phase, holds in rules if holds), "supervisor")


def probes_left(lab: Lab) -> int:
    return sum(int(f.get("remaining_cheap_probes") or 0) for f in lab.frontier["family_funding"].values())


def summary(lab: Lab) -> DataFrame:
    """One row of what a lab stands at: counts over the log by Spark, the rest from the documents."""
    status = F.col("status")
    n = lab.current.agg(F.count(F.lit(1)).alias("n"), F.count_if(status.isin(*PENDING)).alias("pending"), F.count_if((status == "invalidated") & (F.col("suspicion") == "invalid_fast")).alias("fast")).first()
    front, champion = lab.frontier, lab.frontier.get("global_champion") or {}
    fast = len(front.get("invalid_fast_candidates") or []) or n["fast"]
    row = {
        "step_count": int(lab.runtime.get("step_count") or 0), "active_phase": lab.runtime.get("active_phase", "idle"), "next_phase": next_phase(lab, n["pending"], n["fast"]),
        "queued_jobs": len(lab.jobs["queued"]), "leased_jobs": len(lab.jobs["leased"]), "finished_jobs": len(lab.jobs["finished"]),
        "worker_leases": sum(w.get("status") == "leased" for w in lab.workers["workers"].values()), "total_workers": len(lab.workers["workers"]),
        "total_candidates": n["n"], "pending_candidates": n["pending"], "n_audit": len(front.get("audit_queue") or []) or fast, "n_invalid_fast": fast,
        "global_champion": champion.get("candidate_id"), "family_credits": json.dumps({k: v.get("credits", 0) for k, v in sorted(front["family_funding"].items())}), "remaining_cheap_probes": probes_left(lab),
    }
    kinds = {int: "bigint", str: "string", type(None): "string"}
    return lab.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))


def dashboard(lab: Lab) -> DataFrame:
    """A row for each family, with the mission and the baseline: what a dashboard shows of the configuration."""
    base = lab.branches.get("production_baseline", {})
    rows = [(lab.branches.get("mission"), base.get("experiment_id"), base.get("description"), name, f.get("description"), f.get("resource_class", "cpu")) for name, f in (lab.branches.get("families") or {}).items()]
    return lab.spark.createDataFrame(rows, "mission string, baseline_id string, baseline string, family string, description string, resource_class string")
