import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trialforge.operators.ordered import plateau_counter
from trialforge.sources import files
from trialforge.streaming import replay

S = "id string, n bigint"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lines_strict_lenient_and_kept(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"id": "x", "n": 1}\n\n  \n{"id": "y"}\n')
    assert [tuple(r) for r in files.read_lines(spark, good, S).orderBy("seq").collect()] == [(0, "x", 1), (1, "y", None)]
    bad = write(tmp_path / "b.jsonl", '{"id": "x", "n": 1}\n{"id": \n{"id": "z", "n": 3}\n')
    with pytest.raises(Exception):
        files.read_lines(spark, bad, S).collect()
    assert [(r.seq, r.id) for r in files.read_lines(spark, bad, S, "drop").orderBy("seq").collect()] == [(0, "x"), (1, "z")]
    kept = files.read_lines(spark, bad, S, "keep").orderBy("seq").collect()
    assert [r.corrupt for r in kept] == [None, '{"id": ', None]
    assert files.read_lines(spark, str(tmp_path / "none"), S).count() == 0


def test_lines_of_several_files_follow_their_names(spark, tmp_path):
    sizes = {"a": 10, "b": 20_000, "c": 300}
    for name, n in sizes.items():
        write(tmp_path / f"{name}.jsonl", "".join(json.dumps({"id": name, "n": i}) + "\n\n" * (i % 7 == 0) + "\n" for i in range(n)))
    want = [(name, i) for name, n in sizes.items() for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = files.read_lines(spark, str(tmp_path), S).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.seq for r in got] == list(range(len(want))) and [(r.id, r.n) for r in got] == want


def test_documents_text_and_yaml(spark, tmp_path):
    doc = write(tmp_path / "d.json", '{\n "id": "x",\n "n": 2\n}')
    assert [tuple(r) for r in files.read_document(spark, doc, S).collect()] == [("x", 2)]
    assert files.read_document(spark, str(tmp_path / "no.json"), S).count() == 0
    assert files.read_text(spark, str(tmp_path / "no.md")) == "" and files.read_text(spark, doc).startswith("{\n")
    assert files.read_yaml(spark, str(tmp_path / "no.yaml"), 7) == 7 and files.read_yaml(spark, doc) == {"id": "x", "n": 2}


def test_named_documents_in_the_order_of_their_names(spark, tmp_path):
    for name in ("b_patch.json", "a_patch.json", "other.json"):
        write(tmp_path / name, json.dumps({"id": name, "n": 0}))
    got = files.read_named(spark, str(tmp_path), "*patch*.json", S).orderBy("seq").collect()
    assert [(r.seq, r.id) for r in got] == [(0, "a_patch.json"), (1, "b_patch.json")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], S)
    log = str(tmp_path / "log")
    files.append_lines(df, log)
    files.append_lines(df.withColumn("n", F.lit(2).cast("long")), log)
    assert sorted(r.n for r in files.read_lines(spark, log, S).collect()) == [1, 2]
    files.create_if_absent(df, log)
    assert files.read_lines(spark, log, S).count() == 2
    files.append_text(df, str(tmp_path / "md"), "- %s: %d")
    assert files.read_text(spark, str(tmp_path / "md")).strip() == "- x: 1"


def test_replacement_moves_the_pointer(spark, tmp_path):
    at = str(tmp_path / "table")
    one = files.replace_atomically(spark.createDataFrame([("x", 1)], S), at)
    assert files.read_current(spark, at).first().n == 1
    two = files.replace_atomically(files.read_current(spark, at).withColumn("n", F.lit(5).cast("long")), at)
    assert files.read_current(spark, at).first().n == 5 and one != two


def test_overlay(spark):
    base, top = spark.createDataFrame([("a", 1), ("b", 2)], S), spark.createDataFrame([("b", 3), ("c", None)], S)
    assert {tuple(r) for r in files.overlaid(base, top, "id").collect()} == {("a", 1), ("b", 3), ("c", None)}


def events(spark, tmp_path, parts):
    for k, rows in enumerate(parts):
        (tmp_path / f"p{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        # a stream takes files in the order of their times
        os.utime(tmp_path / f"p{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(tmp_path)


def test_stream_of_plateau_counters_equals_the_batch(spark, tmp_path):
    rows = [{"g": f"g{k % 3}", "seq": k, "promoted": k % 7 == 0, "rejected": k % 7 != 0 and k % 2 == 0} for k in range(60)]
    schema = "g string, seq bigint, promoted boolean, rejected boolean"
    folder = events(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    q = replay.plateau_counters(stream, "g").writeStream.format("memory").queryName("plateaus").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = plateau_counter(spark.createDataFrame([tuple(r.values()) for r in rows], schema), "g", "seq", F.col("promoted"), F.col("rejected"))
    assert {tuple(r) for r in spark.table("plateaus").collect()} == {(r.g, r.seq, r.plateau) for r in batch.collect()}


def test_latest_records_by_batches_and_again(spark, tmp_path):
    schema = "id string, seq bigint, status string"
    parts = [[("a", 1, "x"), ("b", 2, "x")], [("a", 3, "y")], [("a", 2, "old")]]
    at = str(tmp_path / "latest")
    for part in [*parts, parts[1]]:
        replay.merged_latest(spark.createDataFrame(part, schema), at, "id", "seq")
    assert {tuple(r) for r in replay.read_latest(spark, at, schema).collect()} == {("a", 3, "y"), ("b", 2, "x")}


def test_repeated_attempts_are_dropped(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [{"id": "a", "attempt": 1, "t": str(t)}, {"id": "a", "attempt": 1, "t": str(t + timedelta(seconds=5))}, {"id": "a", "attempt": 2, "t": str(t)}]
    stream = spark.readStream.schema("id string, attempt bigint, t timestamp").json(events(spark, tmp_path, [rows]))
    q = replay.first_attempts(stream, "t", "1 hour", ["id", "attempt"]).writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.attempt for r in spark.table("firsts").collect()) == [1, 2]
    latest = replay.latest_records(spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "id string, seq bigint, v bigint"), "id", "seq")
    assert [tuple(r) for r in latest.collect()] == [("a", 2, 6)]


def test_leases_run_out(spark, tmp_path):
    rows = [{"job_id": 1, "seq": 1, "status": "leased"}, {"job_id": 2, "seq": 1, "status": "leased"}, {"job_id": 2, "seq": 2, "status": "finished"}]
    folder = events(spark, tmp_path, [rows[:1], rows[1:]])
    stream = spark.readStream.schema("job_id bigint, seq bigint, status string").json(folder)
    q = replay.expiring_leases(stream, 1000).writeStream.format("memory").queryName("leases").outputMode("append").trigger(processingTime="500 milliseconds").start()
    import time

    for _ in range(60):
        time.sleep(0.5)
        got = {tuple(r) for r in spark.table("leases").collect()}
        if (1, "expired") in got:
            break
    q.stop()
    assert {(1, "leased"), (1, "expired")} <= got and (2, "expired") not in got
