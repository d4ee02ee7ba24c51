"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="trialforge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, tag: str, parts: list[str] | None = None) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and returns the table read back, with its path; parts are columns that split it into folders.

    The table survives the loss of executors and makes values such as partition numbers stable.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def split_by(df: DataFrame, key: str) -> DataFrame:
    """df as bucketed() takes it: one partition for each bucket."""
    return df.repartition(_buckets(df.sparkSession), key)


def bucketed(df: DataFrame, tag: str, key: str) -> DataFrame:
    """As materialize(), in buckets by key of a df that split_by() has split: joins on the key don't move the table again."""
    spark = df.sparkSession
    name = f"trialforge_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(_buckets(spark), key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    _written.append((spark, path))
    return spark.table(name)


def together(*makers: Callable) -> list:
    """What the makers return; their jobs run side by side, so that small ones don't wait for each other."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return [x.result() for x in [pool.submit(m) for m in makers]]


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of materialize() that no plan reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _discard_all() -> None:
    for spark, path in list(_written):
        try:
            discard(spark, path)
        except Exception:  # the session has ended
            break
