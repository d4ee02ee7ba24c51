from datetime import datetime, timedelta

from trialforge.functions import bloom
from trialforge.operators.orphans import lab_orphans, orphan_counts, orphan_references
from pyspark.sql import functions as F

T = datetime(2026, 3, 1)
C = "candidate_id string, parent_ids array<string>, created_at timestamp, recorded_at timestamp, ref_id string, kind string"
EV = "candidate_id string, attempt bigint, evaluated_at timestamp, src string"
WO = "snapshot_id bigint, workers map<string, struct<current_candidate_id string, leased_at timestamp>>, at timestamp"
RE = "candidate_id string, removed_at timestamp, first_removed timestamp"


def run(spark, c, e=(), w=(), r=()):
    frames = [spark.createDataFrame(list(x), s) for x, s in ((c, C), (e, EV), (w, WO), (r, RE))]
    return {tuple(x) for x in lab_orphans(*frames).collect()}


def day(n):
    return T + timedelta(days=n)


def test_kinds(spark):
    c = [("a", None, day(0), day(5), "q", "q"), ("A ", [], day(0), day(2), "q", "q"), ("b", [" a", "gone", None, " ", "B"], day(1), day(1), "q", "q"), ("b", [" a", "gone"], day(1), day(9), "q", "q")]
    e = [("a", 1, day(3), "x"), ("a", 2, day(1), "x"), ("nope", 3, None, "x"), (" ", 4, day(1), "x"), (None, 5, day(1), "x"), ("b", 6, None, "x"), ("b", 7, day(40), "x"), ("NOPE", 3, None, "x")]
    w = [(1, {"cpu-1": ("b", day(40)), "cpu-2": None, "cpu-3": (None, day(1)), "cpu-4": ("zz", day(40))}, day(1)), (2, None, None)]
    r = [("B", day(30), None), ("b", day(50), None), ("other", day(1), None)]
    assert run(spark, c, e, w, r) == {
        ("candidates", "b", "a", "late", "2026-03"), ("candidates", "b", "gone", "missing", "2026-03"),
        ("evaluations", "2", "a", "late", "2026-03"), ("evaluations", "3", "nope", "missing", "unknown"), ("evaluations", "7", "b", "deleted", "2026-04"),
        ("workers", "1:cpu-1", "b", "deleted", "2026-04"), ("workers", "1:cpu-4", "zz", "missing", "2026-04"),
    }


def test_no_records_at_all(spark):
    assert run(spark, []) == set()
    assert run(spark, [], [("a", 1, day(0), "x")]) == {("evaluations", "1", "a", "missing", "2026-03")}


def test_counts(spark):
    rows = [("s", str(i), "r", "missing", "2026-01") for i in range(3)]
    df = spark.createDataFrame(rows, "src string, src_key string, ref_id string, kind string, ref_month string")
    assert [tuple(r) for r in orphan_counts(df).collect()] == [("s", "missing", "2026-01", 3)]


def test_hot_reference(spark):
    c = [("hub", None, day(0), day(9), "", "")] + [(f"c{i}", ["hub"], day(1), day(1), "", "") for i in range(400)]
    got = run(spark, c)
    assert len(got) == 400 and {x[3] for x in got} == {"late"}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    words = bloom.build(keys, "h", bloom.bits_for(20_000))
    hit = spark.range(40_000).select("id", bloom.may_contain(spark.sparkContext.broadcast(words), F.xxhash64("id")).alias("m")).groupBy((F.col("id") < 20_000).alias("there")).agg(F.count_if("m").alias("n")).collect()
    n = {r.there: r.n for r in hit}
    assert n[True] == 20_000 and n[False] < 800
    assert bloom.bits_for(10**12) == bloom.MAX_BITS


def test_more_keys_than_one_filter_serves(spark):
    keys = spark.range(3_000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(T).alias("first_seen"), F.lit(None).cast("timestamp").alias("first_removed"))
    refs = spark.range(9_000).select(F.lit("s").alias("src"), F.col("id").cast("string").alias("src_key"), F.concat(F.lit("k"), F.col("id") % 6_000).alias("ref_id"), F.lit(day(1)).alias("at"))
    assert bloom.ranges_for(3_000, 1 << 13) == 4 and bloom.ranges_for(3_000) == 1
    whole, split = ({tuple(r) for r in orphan_references(refs, keys, most).collect()} for most in (bloom.MAX_BITS, 1 << 13))
    assert whole == split and len(whole) == 3_000
