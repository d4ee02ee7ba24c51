"""The log as a stream: latest records kept up to date, counters for each group, and leases that run out by themselves.

A batch over the whole log and the stream over its parts give the same answer; `seq` is the order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialforge.sources import files


def first_attempts(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """Rows whose keys haven't come before within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def latest_records(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key so far; write it in update or complete mode."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("x")).select(key, "x.*")


def plateau_counters(stream: DataFrame, group: str) -> DataFrame:
    """group, seq and plateau at each row (group, seq, promoted, rejected): rejections since the last promotion.

    Rows of a micro-batch are sorted by seq; a row that comes after later ones of its group is counted when it comes.
    """
    kind = dict(stream.dtypes)[group]

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for promoted, rejected in zip(rows["promoted"], rows["rejected"]):
            n = 0 if promoted else n + bool(rejected)
            out.append(n)
        state.update((n,))
        yield pd.DataFrame({group: rows[group], "seq": rows["seq"], "plateau": out})

    return stream.groupBy(group).applyInPandasWithState(count, f"{group} {kind}, seq bigint, plateau bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


def expiring_leases(stream: DataFrame, timeout_ms: int) -> DataFrame:
    """job_id, event: `leased` when a lease comes in, `expired` when nothing more was heard of it for the timeout."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "event": ["expired"]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        if rows["status"].iloc[-1] == "leased":
            fresh = not state.exists
            state.update((int(rows["seq"].iloc[-1]),))
            state.setTimeoutDuration(timeout_ms)
            if fresh:
                yield pd.DataFrame({"job_id": [key[0]], "event": ["leased"]})
        elif state.exists:
            state.remove()

    return stream.groupBy("job_id").applyInPandasWithState(watch, "job_id bigint, event string", "seq bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Buckets of a table of latest records; a micro-batch rewrites those that it touches.
BUCKETS = 64


def _manifest(spark: SparkSession, path: str) -> dict[str, str]:
    return json.loads(files.read_text(spark, f"{path}/CURRENT") or "{}")


def merged_latest(batch: DataFrame, path: str, key: str, seq: str, buckets: int = BUCKETS) -> None:
    """For foreachBatch: folds a micro-batch into the table of latest records. Keys are spread over buckets; only the buckets that the batch
    touches are read and written, as a new version beside the old ones, and then the list of what is current is replaced in one step.
    Running a batch again changes nothing, as the highest seq of a key wins. Versions that nothing refers to any more go."""
    spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = batch.withColumn("_bucket", bucket)
    touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # as many as there are buckets at most
    if not touched:
        return
    current = _manifest(spark, path)
    held = [f"{path}/{current[str(b)]}/_bucket={b}" for b in touched if str(b) in current]
    if held:
        rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*held).withColumn("_bucket", bucket))
    rest = [c for c in batch.columns if c != key]
    latest = rows.groupBy(key, "_bucket").agg(F.max_by(F.struct(*rest), seq).alias("x")).select("_bucket", key, "x.*")
    version = f"v-{uuid.uuid4().hex}"
    latest.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{version}")
    made = current | {str(b): version for b in touched}
    files.write_text(spark, f"{path}/CURRENT", json.dumps(made, sort_keys=True))
    # what was current until now may still be read; what was replaced before goes with the next batch
    files.remove_all(spark, path, keep={*made.values(), *current.values(), "CURRENT"})


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that merged_latest keeps."""
    paths = [f"{path}/{v}/_bucket={b}" for b, v in _manifest(spark, path).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
