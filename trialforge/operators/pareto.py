"""Pareto layers of points whose objectives are all to be maximised.

A first pass lets each task drop what its own points dominate. The survivors, few of many points but not bounded, are compared in
cells: a slice of the points against a block of those that may dominate them, so that no task holds more than two blocks.

Defined results: points with a null objective have no layer; equal points don't dominate each other; an empty input has no layers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.functions.lineage import materialize


#: Rows of a block, and those compared at once.
BLOCK, STEP = 8192, 512


def _complete(objectives: list[str]) -> str:
    return " and ".join(f"`{o}` is not null" for o in objectives)


def _skyline(points: np.ndarray, block: int = 2048) -> np.ndarray:
    """Which points no other dominates. Sorted by their sum, a point can only be dominated by one before it."""
    order = np.argsort(-points.sum(axis=1), kind="stable")
    front = np.empty((0, points.shape[1]))
    keep = np.zeros(len(points), dtype=bool)
    for a in range(0, len(order), block):
        part = order[a : a + block]
        x = points[part]
        for ref in (front, x):
            if len(ref):
                ge = (ref[None, :, :] >= x[:, None, :]).all(axis=2)
                gt = (ref[None, :, :] > x[:, None, :]).any(axis=2)
                alive = ~(ge & gt).any(axis=1)
                part, x = part[alive], x[alive]
        keep[part] = True
        front = np.vstack([front, x])
    return keep


def _dominates(testers: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row of x which testers dominate it."""
    return (testers[None, :, :] >= x[:, None, :]).all(axis=2) & (testers[None, :, :] > x[:, None, :]).any(axis=2)


def _in_cells(tested: DataFrame, testers: DataFrame, counts: tuple[int, int], key: str, test: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int) -> DataFrame:
    """test(slice, block) of every slice of `tested` with every block of `testers`; both are cut by hash into pieces of about `block`
    rows, of which counts says the totals."""
    slices, blocks = (max(1, -(-n // block)) for n in counts)
    cut = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = tested.withColumn("_s", cut(tested, slices)).withColumn("_b", every(blocks))
    b = testers.withColumn("_b", cut(testers, blocks)).withColumn("_s", every(slices))
    return a.groupBy("_s", "_b").cogroup(b.groupBy("_s", "_b")).applyInPandas(test, schema)


def front(points: DataFrame, objectives: list[str], block: int = BLOCK) -> DataFrame:
    """The points that no other dominates."""
    complete = points.where(_complete(objectives))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = both[_skyline(both[objectives].to_numpy(dtype=float))]
        if held is not None:
            yield held

    alive, _ = materialize(complete.mapInPandas(local, complete.schema).withColumn("_id", F.monotonically_increasing_id()), "survivors")
    n = alive.count()
    if n <= block:
        return alive.repartition(1).mapInPandas(local, alive.schema).drop("_id")

    def test(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, q = x[objectives].to_numpy(dtype=float), y[objectives].to_numpy(dtype=float)
        hit = np.zeros(len(p), dtype=bool)
        for k in range(0, len(q), STEP):
            left = np.flatnonzero(~hit)
            hit[left] = _dominates(q[k : k + STEP], p[left]).any(axis=1)
        return x.loc[hit, ["_id"]]

    flat = alive.select("_id", *objectives)
    beaten = _in_cells(flat, flat.drop("_id"), (n, n), "_id", test, "_id bigint", block).distinct()
    return alive.join(beaten, "_id", "left_anti").drop("_id")


def layers(points: DataFrame, key: str, objectives: list[str], most: int | None = None, block: int = BLOCK) -> DataFrame:
    """key and layer, 0 for the front, of all points or of the first `most` layers.

    A point's layer is the length of the longest chain of points that dominate each other above it. Points are taken in blocks by
    falling sum of their objectives, as only points of a greater sum can dominate: each block is compared in cells with all blocks
    before it, whose layers are known, and then within itself. So there is a round for each block, not for each layer. Where sums are
    equal but for their rounding, the objectives themselves order a point before those it dominates.
    """
    kind = dict(points.dtypes)[key]
    total = sum((F.col(o).cast("double") for o in objectives[1:]), F.col(objectives[0]).cast("double"))
    flat = points.select(key, *[F.col(o).cast("double").alias(o) for o in objectives]).where(_complete(objectives))
    spark, n = points.sparkSession, flat.count()
    blocks = max(1, -(-n // block))
    placed = flat.withColumn("_sum", total)
    if blocks > 1:
        placed = placed.repartitionByRange(blocks, F.col("_sum").desc(), *[F.col(o).desc() for o in objectives]).withColumn("_block", F.spark_partition_id())
    else:
        placed = placed.repartition(1).withColumn("_block", F.lit(0))
    placed, _ = materialize(placed, "blocks")
    names = ", ".join(f"`{o}` double" for o in objectives)

    def above(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, q, layer = x[objectives].to_numpy(), y[objectives].to_numpy(), y["layer"].to_numpy()
        least = np.zeros(len(p), dtype=np.int64)
        for k in range(0, len(q), STEP):
            hit = _dominates(q[k : k + STEP], p)
            least = np.maximum(least, np.where(hit, layer[k : k + STEP][None, :] + 1, 0).max(axis=1, initial=0))
        return pd.DataFrame({key: x[key], "least": least})

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            x = pd.concat(held, ignore_index=True).sort_values(["_sum", *objectives], ascending=False, ignore_index=True)
            p, layer = x[objectives].to_numpy(), x["least"].to_numpy().astype(np.int64)
            for i in range(1, len(p)):
                hit = (p[:i] >= p[i]).all(axis=1) & (p[:i] > p[i]).any(axis=1)
                if hit.any():
                    layer[i] = max(layer[i], layer[:i][hit].max() + 1)
            yield x[[key, *objectives]].assign(layer=layer)

    paths: list[str] = []
    schema = f"`{key}` {kind}, {names}, layer bigint"
    for b in range(blocks):
        own = placed.where(F.col("_block") == b)
        if paths:
            known = spark.read.schema(schema).parquet(*paths)
            found = _in_cells(own.select(key, *objectives), known.select(*objectives, "layer"), (block, b * block), key, above, f"`{key}` {kind}, least bigint", block)
            found = found.groupBy(key).agg(F.max("least").alias("least"))
            own = own.join(found, key, "left")
        else:
            own = own.withColumn("least", F.lit(0).cast("bigint"))
        done = own.select(key, *objectives, "_sum", F.coalesce("least", F.lit(0)).cast("bigint").alias("least")).repartition(1).mapInPandas(within, schema)
        paths.append(materialize(done, "layers")[1])
    out = spark.read.schema(schema).parquet(*paths).select(key, "layer")
    return out if most is None else out.where(F.col("layer") < most)


def dominators(points: DataFrame, key: str, objectives: list[str], block: int = BLOCK) -> DataFrame:
    """key, how many points of the front dominate it, and the least key among these; null for the front's own points."""
    kind = dict(points.dtypes)[key]
    flat, _ = materialize(points.where(_complete(objectives)).select(key, *[F.col(o).cast("double").alias(o) for o in objectives]), "points")
    best, _ = materialize(front(flat, objectives).withColumnRenamed(key, "_by"), "front")

    def test(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("_by", ignore_index=True)
        p, q = x[objectives].to_numpy(), y[objectives].to_numpy()
        n, first = np.zeros(len(p), dtype=np.int64), np.full(len(p), -1, dtype=np.int64)
        for k in range(0, len(q), STEP):
            hit = _dominates(q[k : k + STEP], p)
            first = np.where((first < 0) & hit.any(axis=1), k + hit.argmax(axis=1), first)
            n += hit.sum(axis=1)
        return pd.DataFrame({key: x[key], "n": n, "_by": [y["_by"].iloc[i] if i >= 0 else None for i in first]})

    parts = _in_cells(flat, best, (flat.count(), best.count()), key, test, f"`{key}` {kind}, n bigint, _by {kind}", block)
    found = parts.groupBy(F.col(key).alias("_k")).agg(F.sum("n").alias("n"), F.min("_by").alias("by"))
    out = flat.join(found, F.col(key) == F.col("_k"), "left")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("dominated_by"), F.col("by").alias("first_dominator"))
