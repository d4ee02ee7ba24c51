"""Readers and writers of logs and state documents: JSON, JSON lines, YAML, text and Markdown.

No schema is inferred: callers give one, and open dictionaries stay JSON text. Reading attaches `seq`, the order of the rows of a
file, as logs are ordered and tables are not.
"""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON document as one row; a missing file gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], _schema(schema))
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType, bad: str = "fail") -> DataFrame:
    """JSON lines with seq. Blank lines are skipped; a bad line fails the read, is dropped or kept apart.

    bad: `fail`; `drop`; `keep` adds the column corrupt with the text of bad lines and null for good ones. A missing file is an
    empty log. seq follows file name and place in the file; folders, as append_lines makes them, are read whole.
    """
    schema = _schema(schema)
    out = T.StructType([T.StructField("seq", T.LongType()), *schema.fields, *([T.StructField("corrupt", T.StringType())] if bad == "keep" else [])])
    if not exists(spark, path):
        return spark.createDataFrame([], out)
    # one line a row; a file is read in blocks, and the id follows the lines of a block
    at = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")]
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", *at).where(F.trim("value") != "")
    mode = "FAILFAST" if bad == "fail" else "PERMISSIVE"
    inner = T.StructType([*schema.fields, T.StructField("corrupt", T.StringType())])
    parsed = lines.select("_f", "_b", "_i", F.from_json("value", schema if bad == "fail" else inner, {"mode": mode, "columnNameOfCorruptRecord": "corrupt"}).alias("_x"), "value")
    if bad == "drop":
        parsed = parsed.where(F.col("_x").isNotNull() & F.col("_x.corrupt").isNull())
    kept = F.coalesce("_x.corrupt", F.when(F.col("_x").isNull(), F.col("value")))
    return _numbered(parsed).select("seq", *[F.col("_x")[f.name].alias(f.name) for f in schema.fields], *([kept.alias("corrupt")] if bad == "keep" else []))


def _numbered(df: DataFrame) -> DataFrame:
    """seq from 0 in the order of file name, block and line: places within blocks plus the rows of the blocks before. What is sorted
    at once is a block of a file; the sums have one row for each block."""
    blocks = df.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(F.col("_f").alias("_file"), F.col("_b").alias("_block"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_f", "_b").orderBy("_i"))
    placed = df.withColumn("_k", place).join(blocks, (F.col("_f") == F.col("_file")) & (F.col("_b") == F.col("_block")))
    return placed.withColumn("seq", F.col("_before") + F.col("_k") - 1)


def read_named(spark: SparkSession, folder: str, pattern: str, schema: str | T.StructType) -> DataFrame:
    """All documents of a folder whose name matches, with seq in the order of their names. Documents are configuration, one a file."""
    docs = spark.read.option("multiLine", True).option("pathGlobFilter", pattern).schema(schema).json(folder)
    return docs.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).withColumn("seq", F.row_number().over(W.orderBy("file")) - 1)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's whole text; empty if it is missing."""
    if not exists(spark, path):
        return ""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files of a text log."""
    return spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")


def read_yaml(spark: SparkSession, path: str, default: object = None) -> object:
    """A configuration as Python values; needs PyYAML, which the cluster may lack: then JSON, which is YAML, is still read."""
    text = read_text(spark, path)
    if not text.strip():
        return default
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        import json

        return json.loads(text)


def append_lines(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines: a folder for each append, numbered, so that later ones are read after it. Of two that append
    at the same time one fails and may try again."""
    fs, p = _fs(df.sparkSession, path)
    n = len(fs.listStatus(p)) if fs.exists(p) else 0
    df.write.mode("error").json(f"{path}/batch-{n:09d}")


def append_text(df: DataFrame, path: str, template: str) -> None:
    """Adds a line of text for each row, made from a format string over the columns in their order; read it with read_texts."""
    df.select(F.format_string(template, *df.columns).alias("value")).write.mode("append").text(path)


def create_if_absent(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and then moves it there in one rename; readers see the old text or the new one."""
    fs, place = _fs(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(temporary, place, options)


def remove_all(spark: SparkSession, path: str, keep: set[str]) -> None:
    """Removes everything in a folder but the names to keep."""
    fs, root = _fs(spark, path)
    for entry in fs.listStatus(root):
        if entry.getPath().getName() not in keep:
            fs.delete(entry.getPath(), True)


def replace_atomically(df: DataFrame, path: str) -> str:
    """Writes a new version beside the others and then moves the pointer file, in one rename; readers see the old or the new one."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    write_text(spark, f"{path}/CURRENT", version)
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names."""
    version = read_text(spark, f"{path}/CURRENT").strip()
    return spark.read.parquet(str(PurePosixPath(path) / version) if "://" not in path else f"{path}/{version}")


def overlaid(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, the top's values win, column by column unless null."""
    t = top.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in top.columns if c != key])
    both = base.join(t, F.col(key) == F.col("_k"), "full")
    rest = [c for c in base.columns if c != key]
    return both.select(F.coalesce("_k", key).alias(key), *[F.coalesce(f"_{c}", c).alias(c) if c in top.columns else F.col(c) for c in rest])
