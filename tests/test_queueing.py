from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trialforge.operators import configs, pareto, queueing, state, temporal

T = datetime(2026, 1, 1)


def test_fill_queue_one_pick_after_the_other(spark):
    given = [("a", 0, 3, 1, 0.5, 0, 5), ("b", 1, 3, 0, None, 0, 5), ("c", 2, 9, 0, 0.0, 4, 1), ("poor", 3, 0, 1, 9.0, 0, 5)]
    df = spark.createDataFrame(given, "family string, seq bigint, credits bigint, probes bigint, champion double, plateau bigint, options bigint")
    credits, options, probes, want = {x[0]: x[2] for x in given}, {x[0]: x[6] for x in given}, {x[0]: x[3] for x in given}, []
    for _ in range(6):
        able = [x for x in given if credits[x[0]] >= 1 and options[x[0]] > 0]
        if not able:
            break
        best = max(able, key=lambda x: (credits[x[0]] + (probes[x[0]] > 0) + (x[4] or 0) - 0.25 * x[5], -x[1]))
        credits[best[0]] -= 1
        options[best[0]] -= 1
        probes[best[0]] -= 1
        want.append(best[0])
    assert [r.family for r in queueing.fill_queue(df, 6).orderBy("pick").collect()] == want
    assert queueing.fill_queue(df, 0).count() == 0 and queueing.fill_queue(df.where("false"), 3).count() == 0


def test_workers_and_matching(spark):
    pools = spark.createDataFrame([(0, "cpu", 9, 5), (1, "cpu", 2, 7), (2, "gpu", 0, 1)], "pos int, resource_class string, slots int, lease_timeout_seconds bigint")
    workers = queueing.worker_pool(pools)
    assert sorted(r.worker_id for r in workers.collect()) == ["cpu-1", "cpu-2"]
    jobs = spark.createDataFrame([(k, k, "cpu", 1 + k % 2, T, k, "queued") for k in range(5)] + [(9, 9, "tpu", 1, T, 9, "queued")], "job_id bigint, candidate_id bigint, resource_class string, attempt bigint, queued_at timestamp, seq bigint, status string")
    assert {(r.worker_id, r.job_id) for r in queueing.match_workers(jobs, workers).collect()} == {("cpu-1", 0), ("cpu-2", 2)}
    assert queueing.match_workers(jobs, workers.where("false")).count() == 0


def test_leases_expire_strictly_after_their_timeout(spark):
    leases = spark.createDataFrame([("w", T, "leased"), ("unknown", T, "leased"), ("w", None, "leased"), ("w", T, "queued")], "worker_id string, leased_at timestamp, status string")
    workers = spark.createDataFrame([("w", 100)], "worker_id string, lease_timeout_seconds bigint")
    late = lambda s, whole=False: sorted(r.worker_id for r in queueing.expired_leases(leases, workers, F.lit(T) + F.make_dt_interval(secs=F.lit(s)), whole_seconds=whole).collect())
    assert late(100.0) == [] and late(100.5) == ["w"] and late(100.5, True) == [] and late(1801.0) == ["unknown", "w"]


@pytest.mark.parametrize("n, want", [(0, 0), (1, 0), (2, 1), (4, 11), (7, 16)])
def test_combinations(spark, n, want):
    df = spark.createDataFrame([(i, f"b{i}") for i in range(n)], "pos int, branch string")
    out = [r.members for r in queueing.combinations(df).orderBy("place").collect()]
    assert len(out) == want and all(len(m) >= 2 for m in out)
    if n == 4:
        masks = [m for m in range(1, 16) if bin(m).count("1") >= 2]
        assert out == [[f"b{i}" for i in range(4) if m >> i & 1] for m in masks]
    if n == 7:
        assert all(len(m) == 2 for m in out)  # 21 pairs leave no place for the whole set


def test_pareto_layers(spark):
    import random

    r = random.Random(1)
    pts = {k: (r.choice([None, *range(8)] if k % 9 == 0 else list(range(8))), r.randrange(8), r.randrange(3)) for k in range(150)}
    df = spark.createDataFrame([(k, *map(lambda x: None if x is None else float(x), v)) for k, v in pts.items()], "k bigint, a double, b double, c double")
    left, want, layer = {k: v for k, v in pts.items() if None not in v}, {}, 0
    beats = lambda x, y: all(p >= q for p, q in zip(x, y)) and x != y
    while left:
        top = {k for k, v in left.items() if not any(beats(o, v) for o in left.values())}
        want |= {k: layer for k in top}
        left, layer = {k: v for k, v in left.items() if k not in top}, layer + 1
    for size in (40, 10_000):
        assert {x.k: x.layer for x in pareto.layers(df, "k", ["a", "b", "c"], block=size).collect()} == want
        assert {x.k for x in pareto.front(df, ["a", "b", "c"], size).collect()} == {k for k, l in want.items() if l == 0}
    front = [pts[k] for k, l in want.items() if l == 0]
    for size in (30, 10_000):
        got = {x.k: x.dominated_by for x in pareto.dominators(df, "k", ["a", "b", "c"], size).collect()}
        assert got == {k: sum(beats(f, pts[k]) for f in front) for k in want}
    assert pareto.layers(df.where("false"), "k", ["a", "b"]).count() == 0


def test_later_parents_replace_earlier_ones(spark):
    rows = [("p1", [], '{"model": {"depth": 4}}'), ("p2", [], '{"lr": 2}'), ("c", ["p1", "gone", "p2"], '{"own": null}'), ("r1", ["r2"], "{}"), ("r2", ["r1"], "{}")]
    df = spark.createDataFrame(rows, "candidate_id string, parent_ids array<string>, config_patch string")
    got = {r.candidate_id: r.config for r in configs.resolved(df, '{"model": {"depth": 1, "w": 8}, "lr": 1}').collect()}
    assert got == {"p1": '{"lr": 1, "model": {"depth": 4, "w": 8}}', "p2": '{"lr": 2, "model": {"depth": 1, "w": 8}}', "c": '{"lr": 2, "model": {"depth": 1, "w": 8}, "own": null}'}


def test_phases(spark):
    def at(**k):
        v = dict(ready=True, init=True, steps=5, exp=False, audits=0, pend=0, flat=False) | k
        c = state.phase(F.lit(v["ready"]), F.lit(v["init"]), F.lit(v["steps"]), 6, F.lit(v["exp"]), F.lit(v["audits"]), F.lit(v["pend"]), F.lit(v["flat"]))
        return spark.range(1).select(c).first()[0]

    # the two named states: three steps with an entry to audit; eight steps, nothing left, on a plateau
    assert at(steps=3, audits=1) == "audit" and at(steps=8, flat=True) == "frame_break"
    assert at(ready=False) == "design" and at(init=False, audits=1) == "supervisor" and at(steps=12, audits=1) == "checkpoint"
    assert at(exp=True, audits=1) == "expansion" and at(pend=1, flat=True) == "supervisor" and at(steps=0) == "supervisor"


def test_asof_join_and_null_times(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "x"), ("b", 9, "x"), ("a", None, "x"), (None, 5, "x")], "k string, t bigint, v0 string")
    right = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 5, 2, 2.0), ("a", 3, 3, None), ("b", 10, 4, 4.0), ("a", None, 5, 9.0)], "k string, u bigint, tie bigint, v double")
    got = {(r.k, r.t): r.v for r in temporal.asof_join(left, right, "k", "t", "u", "v", "tie").collect()}
    assert got == {("a", 5): 2.0, ("a", 1): None, ("b", 9): None, ("a", None): None, (None, 5): None}


def test_purged_against_all_pairs(spark):
    import random

    r = random.Random(2)
    make = lambda n, o: [(o + k, a := r.randrange(500), a + r.randrange(20)) for k in range(n)]
    train, test = make(300, 0), make(25, 1000)
    f = lambda x: spark.createDataFrame(x, "id bigint, a bigint, b bigint")
    got = {x.id for x in temporal.purged(f(train), f(test), "a", "b", 3, 17).collect()}
    assert got == {i for i, a, b in train if not any(a <= d + 3 and b >= c - 3 for _, c, d in test)}
    assert temporal.purged(f(train), f(test).where("false"), "a", "b", 3, 17).count() == 300
