"""Configurations are resolved over the whole table and along chains of any depth."""

import json
import random

import pytest

from trialforge.operators import configs
from trialforge.plans import catalogue


def test_chain_of_seventy_levels_and_rings(spark):
    rows = [(f"c{k}", [f"c{k - 1}"] if k else [], json.dumps({f"k{k}": k})) for k in range(70)]
    rows += [("r1", ["r2"], "{}"), ("r2", ["r1"], "{}"), ("under", ["c3", "r1"], "{}"), ("two", ["c69", "c1"], '{"k1": 0}')]
    df = spark.createDataFrame(rows, "candidate_id string, parent_ids array<string>, config_patch string")
    got = {r.candidate_id: json.loads(r.config) for r in configs.resolved(df, '{"lr": 1}').collect()}
    assert got == {f"c{k}": {"lr": 1} | {f"k{i}": i for i in range(k + 1)} for k in range(70)} | {"two": {"lr": 1} | {f"k{i}": i for i in range(70)} | {"k1": 0}}


@pytest.mark.parametrize("few", [0, 20_000])
def test_both_ways_agree(spark, monkeypatch, few):
    r = random.Random(4)
    rows = [(f"c{k}", r.sample([f"c{j}" for j in range(k)], min(k, r.randrange(3))), json.dumps({r.choice("ab"): r.choice([1, None, {"x": k}, {"y": {"z": k}}])})) for k in range(40)]
    rows += [("r", ["r"], "{}"), ("odd", ["c3", "gone"], "no json"), ("null", ["odd"], None)]
    base, by, done = {"a": {"x": 0}}, {c: (p, q) for c, p, q in rows}, {}

    def config(c):
        if c not in done:
            x = base
            for p in by[c][0]:
                if p in by:
                    x = configs.merged(configs.merged(x, config(p)), configs._object(by[p][1]))
            done[c] = configs.merged(x, configs._object(by[c][1]))
        return done[c]

    monkeypatch.setattr(configs, "FEW", few)
    df = spark.createDataFrame(rows, "candidate_id string, parent_ids array<string>, config_patch string")
    got = {x.candidate_id: json.loads(x.config) for x in configs.resolved(df, json.dumps(base)).collect()}
    assert got == {c: config(c) for c in by if c != "r"}


def test_a_chain_of_a_thousand(spark):
    rows = [(f"c{k}", [f"c{k - 1}"] if k else [], json.dumps({f"k{k % 7}": k})) for k in range(1001)]
    df = spark.createDataFrame(rows, "candidate_id string, parent_ids array<string>, config_patch string")
    got = {r.candidate_id: json.loads(r.config) for r in configs.resolved(df, "{}").collect()}
    assert len(got) == 1001 and got["c1000"] == {f"k{k % 7}": k for k in range(994, 1001)}


def test_every_part(spark, tmp_path):
    many = spark.range(1, 1301).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size")
    many.write.parquet(str(tmp_path / "part.parquet"))
    got = {r.candidate_id: json.loads(r.config) for r in catalogue.QUERIES["resolved_config"](spark, str(tmp_path)).collect()}
    # each candidate sets one of five keys; the others come from the nearest ancestor that sets them
    want = {}
    for k in range(1, 1301):
        own = {f"k{k % 5}": {"depth": k % 50 + 1, "seed": 1}}
        want[str(k)] = (want[str(k // 2)] if k > 1 else {"model": {"depth": 1, "type": "base"}}) | own
    assert got == want
