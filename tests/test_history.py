import random

import model
from pyspark.sql import functions as F

from trialforge.operators import history
from trialforge.operators.history import appended, end_dated, satellite, versions

SCHEMA = "id string, status string, at bigint, seq bigint, key string, part int, hash_diff string"


def run(spark, rows, monkeypatch=None, hot=None):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)
    if hot is not None:
        monkeypatch.setattr(history, "hot_keys", lambda *a, **k: hot)
    from trialforge.functions.text import folded, present

    good = df.where(present("id") & present("status"))
    sat, found = satellite(good, folded("id"), F.col("at"), F.col("seq"), {"status": folded("status")})
    return {(r.key, r.status, r.at_us, r.until_us) for r in end_dated(sat, found).collect()}


def rows(seed, n=400):
    r = random.Random(seed)
    out = [(r.choice(["a", " A", "b\t", "c", None, " "]), r.choice(["x", "X ", "y", "z", None, ""]), r.choice([None, *range(40)]), q) for q in range(n)]
    return out + r.sample(out, 50)


def test_versions_match_the_model(spark):
    for seed in range(3):
        got = rows(seed)
        assert run(spark, got) == model.versions([x for x in got])


def test_hot_keys_in_slices_change_nothing(spark, monkeypatch):
    got = rows(7, 900)
    assert run(spark, got, monkeypatch, ["a", "b"]) == model.versions(got)


def test_empty(spark):
    assert run(spark, []) == set()


def test_null_attributes_are_versions_and_unchanged_rows_add_nothing(spark):
    df = spark.createDataFrame([("a", None, 1, 1), ("a", None, 2, 2), ("a", "", 3, 3), ("a", "", 4, 4), ("a", None, 5, 5)], "id string, v string, at bigint, seq bigint")
    sat, hot = satellite(df, F.col("id"), F.col("at"), F.col("seq"), {"v": F.col("v")})
    assert [(r.at_us, r.v) for r in sat.orderBy("at_us").collect()] == [(1, None), (3, ""), (5, None)]


def test_a_store_that_is_appended_to_gives_the_versions_of_the_whole_log(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), r.randrange(12), i, r.choice("xyz")) for i in range(120)] + [(None, 1, 500, "x"), ("a", None, 501, "x"), ("d", 4, None, "x")]
    df = spark.createDataFrame(rows, "key string, at_us bigint, seq bigint, v string")
    make = (F.col("key"), F.col("at_us"), F.col("seq"), {"v": F.col("v")})
    sat, _ = satellite(df.where("seq < 40"), *make)
    stored = sat.select("key", "at_us", "hash_diff", F.lit(0).alias("load"), "v")
    for load, (a, b) in enumerate([(40, 60), (60, 61), (61, 600)], 1):
        log, before = df.where(f"seq < {b}"), {tuple(x) for x in stored.collect()}
        batch = log.where(f"seq >= {a}")
        new = appended(stored, batch, log, *make, load)
        stored = spark.createDataFrame(stored.unionByName(new).collect(), stored.schema)
        assert before <= {tuple(x) for x in stored.collect()}
        want = {(x.key, x.at_us, x.v, x.until_us) for x in end_dated(*satellite(log, *make)).collect()}
        assert {(x.key, x.at_us, x.v, x.until_us) for x in versions(stored, {"v": None}).collect()} == want
        assert appended(stored, batch, log, *make, load).count() == 0


def test_change_rates(spark):
    df = spark.createDataFrame([("a", "x", "k", 1), ("a", "y", "k", 2), ("a", "y", "k", 3)], "id string, v string, w string, at bigint")
    out = history.change_rates(df, F.col("id"), F.col("at"), F.col("at"), {"v": F.col("v"), "w": F.col("w")})
    assert {tuple(r) for r in out.collect()} == {("v", 2, 1), ("w", 2, 0)}
