import random

import pytest
from pyspark.sql import functions as F

from trialforge.operators.topn import current_rows, top_n

SCHEMA = "g string, s double, i string, place bigint, part int"


def want(rows, n):
    out = set()
    for g in {r[0] for r in rows if r[0] is not None}:
        good = sorted({(-(r[1] + 0.0), r[2].encode()) for r in rows if r[0] == g and r[1] is not None and r[1] - r[1] == 0 and r[2] is not None})
        out |= {(g, k + 1, i.decode()) for k, (_, i) in enumerate(good[:n])}
    return out


@pytest.mark.parametrize("n, groups, size", [(3, 40, 900), (1, 3, 300), (5, 1, 2000)])
def test_matches_sorting(spark, n, groups, size):
    r = random.Random(n)
    rows = [(r.choice([None, *[f"g{x}" for x in range(groups)]]), r.choice([None, float("nan"), float("inf"), -0.0, 0.0, r.randrange(30) / 10, -1.5]), f"i{r.randrange(size)}é") for _ in range(size)]
    rows += rows[:100]
    df = spark.createDataFrame([(*x, 7, 7) for x in rows], SCHEMA)
    got = [tuple(x) for x in top_n(df, "g", "s", "i", n).collect()]
    assert len(got) == len(set(got)) and set(got) == want(rows, n)


def test_group_over_many_partitions(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).cast("string").alias("g"), (F.col("id") % 1000).cast("double").alias("s"), F.format_string("%06d", "id").alias("i"))
    got = {r.rank_no: r.i for r in top_n(df, "g", "s", "i", 12).where("g = '-1'").collect()}
    rows = [(-(k % 1000), f"{k:06d}") for k in range(30_000) if k % 3]
    assert got == {k + 1: i for k, (_, i) in enumerate(sorted(rows)[:12])}


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "s", "i", 3).count() == 0


def test_current_rows(spark):
    rows = [("a", "F ", 1.0, 5, 1, 3), ("A", "g", 2.0, 5, 1, 4), ("a", "h", 3.0, 9, None, 9), ("a", "h", 4.0, 1, 2, 9), (" ", "f", 1.0, 5, 1, 1)]
    df = spark.createDataFrame(rows, "candidate_id string, family string, selection_eval double, u bigint, c bigint, seq bigint").select("*", F.timestamp_seconds("u").alias("updated_at"), F.timestamp_seconds("c").alias("created_at"))
    assert [tuple(r) for r in current_rows(df).collect()] == [("a", "g", 2.0)]
