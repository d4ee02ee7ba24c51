import random

import pytest
from pyspark.sql import functions as F

from trialforge.functions import skew
from trialforge.operators import ordered

SCHEMA = "g string, seq bigint, x double, e boolean, _v int"


def rows(seed, n=300):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "a", "b", None]), q, r.choice([None, 0.0, *[r.randrange(-20, 40) / 4] * 4]), r.random() < 0.6, 1) for q in range(n)]


def frame(spark, got):
    return spark.createDataFrame([x[:4] for x in got], "g string, seq bigint, x double, e boolean")


@pytest.fixture(params=[False, True])
def hot(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(skew, "hot_keys", lambda *a, **k: ["a"])
    return request.param


def groups(got):
    out = {}
    for g, q, x, e, _ in sorted(got, key=lambda t: t[1]):
        out.setdefault(g, []).append((q, x, e))
    return out


@pytest.mark.parametrize("how", ["max", "sum", "last"])
@pytest.mark.parametrize("current", [False, True])
def test_running(spark, hot, how, current):
    got = rows(1)
    out = {(r.g, r.seq): r.r for r in skew.running(frame(spark, got), "g", "seq", F.col("x"), how, "r", current).collect()}
    for g, l in groups(got).items():
        for k, (q, _, _) in enumerate(l):
            seen = [x for _, x, _ in l[: k + current] if x is not None]
            want = None if not seen else max(seen) if how == "max" else pytest.approx(sum(seen)) if how == "sum" else seen[-1]
            assert out[g, q] == want


def test_leaders(spark, hot):
    got = rows(2)
    want = set()
    for g, l in groups(got).items():
        bar = None
        for q, x, _ in l:
            if x is not None and (bar is None or x > bar):
                want.add((g, q))
                bar = x
    assert {(r.g, r.seq) for r in ordered.prefix_leaders(frame(spark, got), "g", "seq", F.col("x")).collect()} == want


def test_leaders_where_zero_counts_as_none(spark):
    for seed in range(4):
        got = [(g, q, x if seed % 2 else None if x is None else -abs(x), e, v) for g, q, x, e, v in rows(seed)]
        want = set()
        for g, l in groups(got).items():
            bar = None
            for q, x, _ in l:
                if x is not None and (not bar or x > bar):
                    want.add((g, q))
                    bar = x
        assert {(r.g, r.seq) for r in ordered.prefix_leaders(frame(spark, got), "g", "seq", F.col("x"), True).collect()} == want


@pytest.mark.parametrize("margin", [0.0, 1.0, 3.0])
def test_champion_fold(spark, hot, margin):
    got = rows(3)
    out = {(r.g, r.seq): r.champion_before for r in ordered.champion_fold(frame(spark, got), "g", "seq", "x", F.col("e"), margin).collect()}
    for g, l in groups(got).items():
        champion = None
        for q, x, e in l:
            assert out[g, q] == champion
            if e and x is not None and (champion is None or x > champion + margin):
                champion = x


def test_plateau_counter(spark, hot):
    got = rows(4)
    out = {(r.g, r.seq): r.plateau for r in ordered.plateau_counter(frame(spark, got), "g", "seq", F.coalesce(F.col("x") > 8, F.lit(False)), F.col("e") & ~F.coalesce(F.col("x") > 8, F.lit(False))).collect()}
    for g, l in groups(got).items():
        n = 0
        for q, x, e in l:
            n = 0 if x is not None and x > 8 else n + e
            assert out[g, q] == n


def test_ledger_balance_is_initial_minus_spent_plus_minted(spark, hot):
    got = rows(5)
    out = ordered.ledger(frame(spark, got), "g", "seq", F.when(F.col("e"), 2).otherwise(-1), 10).collect()
    last = max((r for r in out if r.g == "a"), key=lambda r: r.seq)
    mine = [e for g, _, _, e, _ in got if g == "a"]
    assert last.balance == 10 + 2 * sum(mine) - sum(not e for e in mine)


def trend(points):
    """points: (score, valid) in order; valid is True, False or None."""
    good = [s for s, v in points if v and s is not None]
    if not good:
        return "collapsed" if any(v is False for _, v in points) else "no_signal"
    k = max(1, len(good) // 3)
    delta = sum(good[-k:]) / k - sum(good[:k]) / k
    if any(v is False for _, v in points[len(points) // 2 :]):
        return "collapsed"
    return "improving" if delta > 0.02 else "regressing" if delta < -0.02 else "plateau"


def test_thirds_trend(spark):
    r = random.Random(9)
    runs = {f"r{k}": [(r.choice([None, r.random(), k / 50]), r.choice([True, True, True, None, False] if k % 3 else [True])) for _ in range(r.randrange(1, 12))] for k in range(120)}
    df = spark.createDataFrame([(k, i, i, s, v) for k, l in runs.items() for i, (s, v) in enumerate(l)], "run string, pos bigint, step bigint, s double, v boolean")
    out = {x.run: (x.trend, x.checkpoints, x.last_step) for x in ordered.thirds_trend(df, "run", "pos", "s", "v", "step").collect()}
    assert out == {k: (trend(l), len(l), len(l) - 1) for k, l in runs.items()}


def test_empty(spark):
    none = frame(spark, [])
    assert ordered.champion_fold(none, "g", "seq", "x", F.col("e"), 1.0).count() == 0
    assert ordered.plateau_counter(none, "g", "seq", F.col("e"), F.col("e")).count() == 0
    assert ordered.prefix_leaders(none, "g", "seq", F.col("x")).count() == 0


def test_lookup_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([("h", i, "x") for i in range(50)] + [("k", 50, "x"), (None, 51, "x"), ("zz", 52, "x")], "k string, n bigint, _right string").drop("_right")
    right = spark.createDataFrame([("h", 1), ("k", 2), (None, 3)], "r string, v bigint")
    for hot_ in ([], ["h"]):
        for how in ("inner", "left"):
            got = sorted((x.n, x.v) for x in skew.lookup_join(left, right, "k", "r", hot_, how).collect())
            want = [(i, 1) for i in range(50)] + [(50, 2)]
            assert [g for g in got if g[1] is not None] == want
            assert len(got) == (53 if how == "left" else 51)


def test_hot_keys(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    assert skew.hot_keys(df, "k") == ["big"]
    assert skew.hot_keys(df.where("false"), "k") == []
