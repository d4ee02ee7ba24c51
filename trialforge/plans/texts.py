"""Queries over text features and classifiers, logs written and read again, and the log as a stream."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.functions.lineage import shared_folder
from trialforge.functions.text import WHITE_SPACE, folded
from trialforge.operators import text_ml
from trialforge.plans.reference import _current
from trialforge.sources import files
from trialforge.sources.files import exists
from trialforge.sources.tables import table
from trialforge.streaming import replay

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '(\w\w+)', 1)) AS term FROM documents) GROUP BY ALL),
w AS (SELECT doc_id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*) OVER (PARTITION BY term))) + 1.0) AS w FROM tf)
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """K1: weights of the words of each document."""
    out = text_ml.tf_idf(table(spark, d, "documents").select("doc_id", "text"), "doc_id", text_ml.word_tokens(F.col("text")))
    return out.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query(f"""
WITH words AS (SELECT ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[{WHITE_SPACE}]+'), lambda x: x <> '')) || ' ' AS w FROM documents),
grams AS (SELECT substr(w, i, k) AS gram FROM (SELECT w, k, unnest(range(1, length(w) - k + 2)) AS i FROM words, (VALUES (3), (4)) AS t(k)))
SELECT gram, count(*) AS n FROM grams GROUP BY gram""")
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """K2: runs of three and four characters within words, over all documents."""
    grams = table(spark, d, "documents").select(F.explode(text_ml.char_ngrams(F.col("text"), 3, 4)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT l_returnflag AS part, l_orderkey % 4 AS truth, CASE WHEN l_quantity > 20 THEN l_orderkey % 4 ELSE l_suppkey % 5 END AS guess FROM lineitem),
l AS (SELECT part, truth AS label FROM p UNION SELECT part, guess FROM p),
f AS (SELECT l.part, l.label, 2.0 * count(*) FILTER (WHERE truth = label AND guess = label) / (count(*) FILTER (WHERE truth = label) + count(*) FILTER (WHERE guess = label)) AS f1 FROM l JOIN p ON l.part = p.part GROUP BY 1, 2)
SELECT f.part, round(avg(f1), 9) AS macro_f1, round(any_value(a), 9) AS accuracy, any_value(n) AS n_rows FROM f JOIN (SELECT part, avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM p GROUP BY 1) s ON f.part = s.part GROUP BY 1""")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """Macro F1 and accuracy of each slice."""
    li = table(spark, d, "lineitem")
    truth = F.col("l_orderkey") % 4
    p = li.select(F.col("l_returnflag").alias("part"), truth.alias("truth"), F.when(F.col("l_quantity") > 20, truth).otherwise(F.col("l_suppkey") % 5).alias("guess"))
    out = text_ml.macro_scores(p, ["part"], "truth", "guess")
    return out.select("part", F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"), "n_rows")


_MIXED_SQL = " OR ".join(f"contains(text, '{w}')" for w in text_ml.MIXED)


@query(f"SELECT doc_id, coalesce(doc_id % 7 IN (0, 4), false) AS extreme, coalesce({_MIXED_SQL}, false) AS mixed FROM documents")
def slice_masks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of extreme labels and texts with words of mixed sentiment."""
    extreme, mixed = text_ml.slice_mask(F.col("text"), F.col("doc_id") % 7)
    return table(spark, d, "documents").select("doc_id", extreme.alias("extreme"), mixed.alias("mixed"))


#: The languages that the classifiers tell apart; their place is the label.
LANGUAGES = ("en", "de", "es", "fr", "zh", "ja")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a known language; three of four are for training."""
    lang = folded("lang")
    place = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), lang) - 1
    docs = table(spark, d, "documents").where(lang.isin(*LANGUAGES) & F.col("text").isNotNull())
    return docs.select("doc_id", "text", place.cast("double").alias("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0).alias("train"))


#: The reference's features: 800 words (here also pairs of words) and half as many runs of 3 to 4 characters, from one text on.
FEATURES = {"words": 800, "min_df": 1, "n": 2, "chars": (3, 4)}


@query()
def text_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """K1-K4, K6: the language of held-out texts by three classifiers, with their scores by macro_scores."""
    counts = text_ml.vectors(_labelled(spark, d), F.col("train"), **FEATURES, weigh=False)
    out = text_ml.classify(counts, ["doc_id", "label"])
    return out.select("kind", "doc_id", F.col("label").cast("int").alias("label"), "prediction")


@query()
def text_scores(spark: SparkSession, d: str) -> DataFrame:
    """E17 over K4: macro F1 and accuracy of each classifier on held-out texts."""
    return text_ml.macro_scores(text_classifiers(spark, d), ["kind"], "label", "prediction")


@query()
def calibrated_text(spark: SparkSession, d: str) -> DataFrame:
    """K5: calibrated probability that a text is English."""
    rows = _labelled(spark, d).withColumn("label", (F.col("label") == 0).cast("double"))
    return text_ml.calibrated(text_ml.vectors(rows, F.col("train"), **FEATURES).drop("text"), F.col("train"), of=1.0).where("not train").select("doc_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), F.round("probability", 6).alias("probability"))


@query("SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS seq, event_id, user_id, event_type FROM events")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A log written as JSON lines and read back strictly, with the order of its rows."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    log = table(spark, d, "events").select("event_id", "user_id", "event_type")
    files.append_lines(log.repartitionByRange("event_id").sortWithinPartitions("event_id"), path)
    return files.read_lines(spark, path, "event_id bigint, user_id bigint, event_type string")


_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)


@query("""SELECT user_id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """2.L: latest records kept by a stream, each micro-batch folded into the buckets of a table that it touches."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _event_stream(spark, d).select("user_id", "event_id", F.col("event_type").alias("status"))
    q = rows.writeStream.foreachBatch(lambda df, _: replay.merged_latest(df, f"{base}/table", "user_id", "event_id")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return replay.read_latest(spark, f"{base}/table", "user_id bigint, event_id bigint, status string")


def _attempts(spark: SparkSession, d: str, base: str) -> DataFrame:
    """The events as a log of attempts with each row delivered twice, the second time a minute late; read as a stream of two files."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("candidate_id"), F.col("ts").cast("timestamp").alias("at"))
    e.repartition(1).write.mode("append").parquet(f"{base}/log")
    e.withColumn("at", F.col("at") + F.expr("INTERVAL 1 MINUTE")).repartition(1).write.mode("append").parquet(f"{base}/log")
    return spark.readStream.schema("event_id bigint, candidate_id bigint, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{base}/log")


def _run(df: DataFrame, base: str, mode: str = "append", **trigger) -> None:
    """Runs a stream over all that is there and writes its table."""
    q = df.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
    if trigger:
        q.processAllAvailable()
        q.stop()
    else:
        q.awaitTermination()


@query("SELECT event_id, user_id AS candidate_id FROM events")
def stream_first_attempts(spark: SparkSession, d: str) -> DataFrame:
    """2.L: late repeats of an attempt are dropped within the watermark."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _run(replay.first_attempts(_attempts(spark, d, base), "at", "60 days", ["event_id"]).select("event_id", "candidate_id"), base)
    return spark.read.parquet(f"{base}/table")


@query("SELECT event_id FROM events")
def polled_view(spark: SparkSession, d: str) -> DataFrame:
    """2.L: a view that is brought up to date every five seconds."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _run(_event_stream(spark, d).select("event_id"), base, processingTime="5 seconds")
    return spark.read.parquet(f"{base}/table")


@query("SELECT n_nationkey AS job_id, CASE WHEN e = 0 THEN 'leased' ELSE 'expired' END AS event FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation), (SELECT unnest(range(2)) AS e) WHERE e = 0 OR n_nationkey % 2 = 0")
def stream_leases(spark: SparkSession, d: str) -> DataFrame:
    """2.L, J7: leases watched by timers of a stream: those that aren't finished run out by themselves."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("job_id"))
    n.select("job_id", F.lit(1).cast("long").alias("seq"), F.lit("leased").alias("status")).coalesce(1).write.mode("append").parquet(f"{base}/log")
    n.where("job_id % 2 = 1").select("job_id", F.lit(2).cast("long").alias("seq"), F.lit("finished").alias("status")).coalesce(1).write.mode("append").parquet(f"{base}/log")
    log = spark.readStream.schema("job_id bigint, seq bigint, status string").option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    watched = replay.expiring_leases(log, 15_000)
    q = watched.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(processingTime="500 milliseconds").start()
    wanted = n.where("job_id % 2 = 0").count()
    for _ in range(60):
        if exists(spark, f"{base}/table") and spark.read.schema("job_id bigint, event string").parquet(f"{base}/table").where("event = 'expired'").count() >= wanted:
            break
        time.sleep(0.5)
    q.stop()
    return spark.read.parquet(f"{base}/table")


@query("""
WITH p AS (SELECT user_id % 5 AS family, event_id AS seq, event_type IN ('error', 'click') AS rejected, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS island FROM events)
SELECT family, seq, count(*) FILTER (WHERE rejected) OVER (PARTITION BY family, island ORDER BY seq) AS plateau FROM p""")
def stream_plateau(spark: SparkSession, d: str) -> DataFrame:
    """2.L, F6: plateau counters kept in the state of a stream."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = F.col("event_type")
    rows = _event_stream(spark, d).select(F.pmod("user_id", F.lit(5)).alias("family"), F.col("event_id").alias("seq"), (e == "purchase").alias("promoted"), e.isin("error", "click").alias("rejected"))
    q = replay.plateau_counters(rows, "family").writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/table")


@query("""
SELECT c_mktsegment AS family, n_name AS pool, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def family_pools(spark: SparkSession, d: str) -> DataFrame:
    """Families with the pools of their class."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    both = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    return both.groupBy(F.col("c_mktsegment").alias("family"), F.col("n_name").alias("pool")).agg(F.count(F.lit(1)).alias("n"))
