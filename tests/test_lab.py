"""A lab's control plane over its files, the runner and made-up runs."""

import json
from datetime import datetime

import pytest

from trialforge.operators import lab, runner
from trialforge.plans.lab import _CONFIG
from trialforge.sources import files

NOW = "2026-01-01T00:00:00+00:00"


@pytest.fixture
def one(spark, tmp_path):
    for name, cfg in _CONFIG.items():
        files.write_text(spark, str(tmp_path / f"{name}.yaml"), json.dumps(cfg))
    return lab.bootstrap(lab.load(spark, str(tmp_path)), NOW)


def epoch(text):
    return datetime.fromisoformat(text).timestamp()


def spec(k, family="width"):
    return {"candidate_id": f"c{k}", "signature": f"s{k}", "family": family, "operator_type": "mutation"}


def test_a_lab_that_is_not_ready(spark, tmp_path):
    empty = lab.load(spark, str(tmp_path))
    assert empty.frontier == lab.empty_frontier() and empty.candidates.count() == 0
    assert lab.next_phase(empty, 0, 0) == "design"
    with pytest.raises(ValueError, match="not ready"):
        lab.bootstrap(empty, NOW)


def test_documents_come_back_as_they_were_saved(spark, one):
    again = lab.load(spark, one.root)
    assert (again.runtime, again.jobs, again.workers, again.frontier) == (one.runtime, one.jobs, one.workers, one.frontier)
    assert list(again.workers["workers"]) == ["cpu-1", "cpu-2", "gpu-1"] and again.workers["workers"]["gpu-1"]["lease_timeout_seconds"] == 60


def test_families_that_cannot_pay_get_nothing(one):
    made = lab.dispatch(one, [spec(k) for k in range(6)] + [spec(9, "nowhere")], NOW)
    assert len(made) == 4 and one.frontier["family_funding"]["width"]["credits"] == 0


def test_leases_run_out_and_jobs_come_back(one):
    lab.dispatch(one, [spec(1)], NOW)
    assert lab.lease(one, "gpu-1", NOW) is None
    job = lab.lease(one, "cpu-1", NOW)
    assert lab.lease(one, "cpu-1", NOW) is None
    assert lab.reap(one, epoch(NOW) + 1800, NOW, epoch) == [] and lab.reap(one, epoch(NOW) + 1801, NOW, epoch) == [job["job_id"]]
    assert one.jobs["queued"][0]["attempt"] == 1 and one.workers["workers"]["cpu-1"]["status"] == "idle"
    with pytest.raises(LookupError):
        lab.complete(one, "c1", {}, NOW)


@pytest.mark.parametrize("stats, champion, want", [
    ((1, 0.5, 0.5, True, True), None, ("evaluating", None)),
    ((2, 0.5, 0.5, True, True), None, ("promoted", None)),
    ((2, 0.5, 0.5, True, False), None, ("rejected", "unstable_frontier")),
    ((2, 0.5, 0.5, True, True), {"selection_eval": 0.49, "search_eval": 0.1}, ("rejected", None)),
    ((1, 0.5, 0.5, False, True), {"selection_eval": 0.9, "search_eval": 0.4}, ("invalidated", "invalid_fast")),
    ((1, None, None, False, True), None, ("rejected", None)),
    ((2, -3.0, -3.0, True, True), {"selection_eval": 0.0, "search_eval": 0.0}, ("promoted", None)),
])
def test_decisions(stats, champion, want):
    names = ("runs", "mean_search", "mean_selection", "all_valid", "stable")
    assert lab.decide(dict(zip(names, stats)), champion, lab.POLICY) == want


def test_a_plateau_raises_the_flag_and_a_checkpoint_is_written(spark, one):
    lab.dispatch(one, [spec(k) for k in range(3)], NOW)
    for _ in range(3):
        job = lab.lease(one, "cpu-1", NOW)
        assert lab.complete(one, job["candidate_id"], {"valid": False}, NOW)["status"] == "rejected"
    assert one.frontier["frame_break_required"] and one.runtime["active_phase"] == "frame_break_needed"
    one.runtime["step_count"] = 5
    lab.dispatch(one, [spec(7, "depth")], NOW)
    lab.complete(one, lab.lease(one, "cpu-1", NOW)["candidate_id"], {"valid": False}, NOW)
    assert files.read_lines(spark, f"{one.root}/state/checkpoints.jsonl", "step_count bigint").collect()[0]["step_count"] == 6


def test_crashes_become_results(spark):
    def odd(doc):
        return {"metrics": {"x": 1 / doc["n"]}}

    rows = [("a", '{"n": 2}'), ("b", '{"n": 0}'), ("c", "{}"), ("d", "["), (None, None), ("e", "[1]")]
    out = {r.candidate_id: r for r in runner.run(spark.createDataFrame(rows, "candidate_id string, document string"), odd).collect()}
    assert {k: r.valid for k, r in out.items()} == {"a": True, "b": False, "c": False, "d": False, None: False, "e": False}
    assert json.loads(out["b"].result)["metrics"]["error"] == out["b"].error == "division by zero"


def test_made_up_runs_repeat_and_collapse(spark):
    one = ("x", 100, 10, 4, 64, 0.0, 10, 0.003, 0.8)
    cfg = spark.createDataFrame([one, ("fast", *one[1:6], 0, 0.015, 0.8), ("none", 0, *one[2:])], "candidate_id string, steps int, every int, depth int, d_model int, dropout double, warmup int, lr double, score double")
    a, b = ([tuple(r) for r in runner.trajectories(cfg).orderBy("candidate_id", "step").collect()] for _ in range(2))
    assert a == b and len([r for r in a if r[0] == "x"]) == 10 and not [r for r in a if r[0] == "none"]
    fast = [r for r in a if r[0] == "fast"]
    assert [r[4] for r in fast] == [True] * (len(fast) - 1) + [False] and fast[-1][2] == 0 and fast[-1][3] is None
