"""Hot groups: nine of ten rows in one group, and no task with more than twice its share of them."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialforge.functions import skew
from trialforge.operators import queueing, temporal
from trialforge.operators.ordered import repeated_failures, z_scores


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    # the orders of the hot group lie close together but for one far away
    data = [("hot" if i % 10 else f"g{i % 7}", i * i if i < 3990 else 10**12 + i, r.choice([None, 0.5, 1.0, 2.0, 9.0]), r.choice(["arch", "data", "ok"])) for i in range(4000)]
    return spark.createDataFrame(data, "g string, o bigint, s double, f string").cache()


def test_slices_hold_about_as_many_rows_each(rows):
    hot = skew.hot_keys(rows, "g")
    assert "hot" in hot
    sizes = [r["count"] for r in rows.where("g = 'hot'").groupBy(skew.order_slices(rows, "g", "o", ["hot"], 16)).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16


def test_positions_are_exact_and_ranges_even(spark, rows):
    got = skew.positions(rows, ["g"], [F.col("o")], "k")
    want = rows.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy("o")).cast("long"))
    assert {(r.g, r.o, r.k) for r in got.collect()} == {(r.g, r.o, r.k) for r in want.collect()}
    parts = [r["count"] for r in rows.repartitionByRange(8, F.col("g"), F.col("o")).groupBy(F.spark_partition_id()).count().collect()]
    assert max(parts) <= 2 * rows.count() / 8


@pytest.mark.parametrize("chunk", [5, 64, 10_000])
def test_rolling_windows_over_chunks(rows, chunk, monkeypatch):
    whole = W.partitionBy("g").orderBy("o").rowsBetween(-4, 0)
    add = lambda df, w: df.withColumn("n", F.count("s").over(w)).withColumn("m", F.sum("s").over(w))
    got = skew.rolling(rows, "g", "o", 5, add, chunk)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, add(rows, whole).select(got.columns).collect()))


def test_operators_over_a_hot_group(rows, monkeypatch):
    w = W.partitionBy("g").orderBy("o").rowsBetween(-2, 0)
    want = rows.withColumn("h", F.sum(F.col("f").isin("arch", "data").cast("int")).over(w)).where("h = 3")
    assert {(r.g, r.o) for r in repeated_failures(rows, "g", "o", "f", ["arch", "data"]).collect()} == {(r.g, r.o) for r in want.collect()}
    assert z_scores(rows, "g", "o", "s").count() == 4000
    jobs = rows.select(F.col("g").alias("resource_class"), F.lit(1).alias("attempt"), F.col("o").alias("queued_at"), F.col("o").alias("seq"), F.lit("queued").alias("status"))
    assert queueing.queue_order(jobs).agg(F.count_distinct("resource_class", "place")).first()[0] == 4000


def test_asof_over_a_hot_key(spark, rows):
    at = F.timestamp_micros("o")
    left = rows.where("o % 3 = 0").select("g", F.col("o").alias("id"), at.alias("t"))
    right = rows.where("o % 3 <> 0").select("g", at.alias("u"), F.col("s").alias("v"), F.col("o").alias("tie"))
    got = {r.id: r.v for r in temporal.asof_join(left, right, "g", "t", "u", "v", "tie").collect()}
    held, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        if r.o % 3:
            held[r.g] = r.s
        else:
            want[r.o] = held.get(r.g)
    assert got == want
