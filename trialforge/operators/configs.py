"""Nested configurations as JSON: patches from paths, deep merges, resolution along lineages, and signatures.

JSON objects of unknown shape are merged in Arrow batches in Python; everything around them is relational.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialforge.functions.lineage import discard, materialize


def merged(base: object, patch: object) -> object:
    """patch over base: objects member by member, everything else (null too) replaces."""
    if isinstance(base, dict) and isinstance(patch, dict):
        return base | {k: merged(base[k], v) if k in base else v for k, v in patch.items()}
    return patch


def _object(text: str | None) -> dict:
    try:
        x = json.loads(text) if text else {}
    except ValueError:
        return {}
    return x if isinstance(x, dict) else {}


def _dump(x: object) -> str:
    return json.dumps(x, sort_keys=True)


@F.pandas_udf(T.StringType())
def deep_merge(base: pd.Series, patch: pd.Series) -> pd.Series:
    """The merge of two JSON objects with sorted keys; what is no object counts as an empty one."""
    return pd.Series([_dump(merged(_object(a), _object(b))) for a, b in zip(base, patch)])


@F.pandas_udf(T.StringType())
def deep_merge_all(layers: pd.Series) -> pd.Series:
    """The merge of a list of JSON objects in their order."""
    out = []
    for parts in layers:
        x: object = {}
        for p in parts if parts is not None else []:
            x = merged(x, _object(p))
        out.append(_dump(x))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def nested_patch(path: pd.Series, value: pd.Series) -> pd.Series:
    """{a: {b: value}} for the path a.b; the value is JSON."""
    out = []
    for p, v in zip(path, value):
        x = json.loads(v)
        for key in reversed(p.split(".")):
            x = {key: x}
        out.append(_dump(x))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def signature(family: pd.Series, operator: pd.Series, patch: pd.Series, parents: pd.Series) -> pd.Series:
    """The first twelve hex digits of the SHA-1 of the candidate's canonical JSON: sorted keys and parents, ASCII escapes."""
    rows = zip(family, operator, patch, parents)
    docs = [{"family": f, "operator_type": o, "config_patch": _object(p), "parent_ids": sorted(q if q is not None else [])} for f, o, p, q in rows]
    return pd.Series([hashlib.sha1(_dump(d).encode()).hexdigest()[:12] for d in docs])


def candidate_id(family: Column, operator: Column, sign: Column) -> Column:
    return F.concat_ws("_", family, operator, sign)


#: What is left to resolve goes through one task once it has no more links than this.
FEW = 20_000


def _rest(links: DataFrame, baseline: str) -> DataFrame:
    """candidate_id, config and config_patch of what can be resolved of a few links (candidate_id, pos, parent, config, parent_patch) and
    own patches, in one task, each after its parents; candidates on or below rings stay out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, str | None] = {}
        above: dict[str, list] = {}
        below: dict[str, list[str]] = {}
        for b in batches:
            for c, pos, parent, config, patch, mine in zip(b["candidate_id"], b["pos"], b["parent"], b["config"], b["parent_patch"], b["config_patch"]):
                own[c] = mine
                above.setdefault(c, []).append((pos, parent, config, patch))
                if config is None:
                    below.setdefault(parent, []).append(c)
        open_ = {c: sum(x[2] is None for x in links) for c, links in above.items()}
        ready, done, out = [c for c, n in open_.items() if not n], {}, []
        while ready:
            c = ready.pop()
            x: object = _object(baseline)
            for _, parent, config, patch in sorted(above[c], key=lambda x: x[0]):
                x = merged(x, _object(config) if config is not None else done[parent])
                x = merged(x, _object(patch if config is not None else own[parent]))
            done[c] = merged(x, _object(own[c]))
            out.append((c, _dump(done[c]), own[c]))
            for child in below.get(c, ()):
                open_[child] -= 1
                if not open_[child]:
                    ready.append(child)
        yield pd.DataFrame(out, columns=["candidate_id", "config", "config_patch"])

    kind = dict(links.dtypes)["candidate_id"]
    return links.repartition(1).mapInPandas(work, f"candidate_id {kind}, config string, config_patch string")


def resolved(candidates: DataFrame, baseline: str) -> DataFrame:
    """candidate_id and config: the baseline, then each parent's resolved configuration and patch in the parents' order, then the
    own patch. Level by level, so a shared ancestor is resolved once. candidates has candidate_id, parent_ids and config_patch.

    As every parent comes with the baseline, what a later parent takes from it replaces an earlier parent's values. Parents that
    aren't there add nothing; candidates on or below rings stay out. Levels end when one resolves nothing: what is left then waits
    for a ring. Levels and the links still open are written to the shared folder, so plans stay as long as at the first level. Once few
    links are open, as on long thin chains, the rest is resolved in one task.
    """
    spark, base = candidates.sparkSession, F.lit(baseline)
    candidates, _ = materialize(candidates.select("candidate_id", "parent_ids", "config_patch"), "candidates")
    links = candidates.select("candidate_id", F.posexplode("parent_ids").alias("pos", "parent"))
    links = links.join(candidates.select(F.col("candidate_id").alias("parent")), "parent", "left_semi")
    empty = F.lit(None).cast("string")
    waiting, path = materialize(links.select("candidate_id", "pos", "parent", empty.alias("config"), empty.alias("parent_patch")), "links")
    roots = candidates.join(waiting.select("candidate_id").distinct(), "candidate_id", "left_anti")
    new, level = materialize(roots.select("candidate_id", deep_merge(base, "config_patch").alias("config"), "config_patch"), "level")
    levels = [level]
    while True:
        # links take what the last level resolved; a candidate is ready when each of its links has a configuration
        last = new.select(F.col("candidate_id").alias("parent"), F.col("config").alias("_config"), F.col("config_patch").alias("_patch"))
        left = waiting.join(new.select("candidate_id"), "candidate_id", "left_anti").join(last, "parent", "left")
        filled, filled_path = materialize(left.select("candidate_id", "pos", "parent", F.coalesce("config", "_config").alias("config"), F.coalesce("parent_patch", "_patch").alias("parent_patch")), "links")
        discard(spark, path)
        waiting, path = filled, filled_path
        if waiting.limit(FEW + 1).count() <= FEW:
            few = waiting.join(candidates.select("candidate_id", "config_patch"), "candidate_id")
            levels.append(materialize(_rest(few, baseline), "level")[1])
            break
        ready = waiting.groupBy("candidate_id").agg(F.every(F.col("config").isNotNull()).alias("ok"), F.array_sort(F.collect_list(F.struct("pos", "config", "parent_patch"))).alias("l")).where("ok")
        layers = F.concat(F.array(base), F.flatten(F.transform("l", lambda x: F.array(x["config"], x["parent_patch"]))), F.array("config_patch"))
        new, level = materialize(candidates.join(ready, "candidate_id").select("candidate_id", deep_merge_all(layers).alias("config"), "config_patch"), "level")
        if new.isEmpty():
            break
        levels.append(level)
    return spark.read.schema(new.schema).parquet(*levels).select("candidate_id", "config")
