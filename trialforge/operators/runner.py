"""Experiments as rows: a runner over candidate documents, whose crashes become result rows, and made-up runs to try a lab with."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run(candidates: DataFrame, runner: Callable[[dict], dict]) -> DataFrame:
    """candidate_id, valid, result and error of a runner over candidates (candidate_id, document). The runner takes the candidate's
    document and returns the result's; what it raises makes an invalid result with the error's text and scores of 0, and the rows of
    other candidates go on. A document that is no JSON object counts as a crash. Null ids are kept. No shuffle."""

    def crashed(ident: str | None, text: str) -> dict:
        score = {"primary_metric": 0.0}
        return {"candidate_id": ident, "valid": False, "proxy_metrics": {}, "metrics": {"search": score, "selection": score, "final": score, "error": text}, "finding": "experiment crashed", "resource_floor": None}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                error = None
                try:
                    doc = json.loads(text or "")
                    if not isinstance(doc, dict):
                        raise TypeError("the candidate is no object")
                    result = {"candidate_id": ident, "valid": True, **runner(doc)}
                    line = json.dumps(result, sort_keys=True)
                except Exception as e:  # whatever a runner raises is its result
                    error = str(e) or type(e).__name__
                    result = crashed(ident, error)
                    line = json.dumps(result, sort_keys=True)
                rows.append((ident, bool(result["valid"]), line, error))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.string(), pa.string()))], ["candidate_id", "valid", "result", "error"])

    flat = candidates.select(F.col("candidate_id").cast("string").alias("candidate_id"), "document")
    return flat.mapInArrow(work, "candidate_id string, valid boolean, result string, error string")


def _uniform(*keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1_000_003)).cast("double") / 1_000_003.0


def _normal(tag: str) -> Column:
    u, v = _uniform("candidate_id", "step", F.lit(tag)), _uniform("candidate_id", "step", F.lit(tag + "'"))
    return F.sqrt(-2.0 * F.log(u + 1e-6)) * F.cos(2 * 3.141592653589793 * v)


def trajectories(configs: DataFrame, noise: float = 0.01, spread: bool = True) -> DataFrame:
    """candidate_id, step, search_eval, loss, valid of made-up runs of configurations (candidate_id, steps, every, depth, d_model, dropout,
    warmup, lr, score): scores that rise towards `score`, and that collapse in deep narrow models and at high rates without warm-up.

    What is random comes from the id and the step, so a run is the same wherever and whenever it is made; with spread false, collapses
    come in the middle of their range.
    """
    deep = (F.col("depth") >= 6) & (F.col("d_model") <= 48)
    fast = (F.col("lr") > 0.008) & (F.col("warmup") < 5)
    u = _uniform("candidate_id") if spread else F.lit(0.5)
    collapse = F.when(deep, F.floor(F.col("steps") * (0.6 + 0.3 * u))).when(fast, F.floor(F.col("steps") * (0.05 + 0.15 * u)))
    every = F.greatest(F.lit(1), F.col("every"))
    steps = F.when(F.col("steps") >= every, F.sequence(every.cast("long"), F.col("steps").cast("long"), every.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    flat = configs.withColumn("collapse", collapse).select("*", F.explode(steps).alias("step"))
    # a run ends with the first step from its collapse on
    flat = flat.where(F.col("collapse").isNull() | (F.col("step") - every < F.col("collapse")))
    lag = F.when(F.col("warmup") > 0, F.greatest(F.lit(0.0), 1 - F.col("step") / F.col("warmup"))).otherwise(0.0)
    rise = F.col("score") * (1 - F.exp(-3.0 * F.col("step") / F.col("steps"))) - 0.05 * lag
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rise + noise * _normal("score")))
    flat = flat.withColumn("s", score).withColumn("over", F.coalesce(F.col("step") >= F.col("collapse"), F.lit(False)))
    loss = F.round(F.greatest(F.lit(0.01), 2.5 * (1 - F.col("s")) + 2 * noise * _normal("loss")), 6)
    kept = F.round("s", 6)
    dropped = F.when(F.col("dropout") > 0.1, F.round(F.greatest(F.lit(0.0), kept - F.col("dropout") * 0.3), 6)).otherwise(kept)
    return flat.select("candidate_id", "step", F.when(F.col("over"), 0.0).otherwise(dropped).alias("search_eval"), F.when(~F.col("over"), loss).alias("loss"), (~F.col("over")).alias("valid"))
