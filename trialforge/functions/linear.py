"""Classifiers over counts of terms, fitted side by side: each asks for its loss at a point, and one reading of the rows answers all.

The models are those of Spark's LogisticRegression, OneVsRest of LinearSVC and multinomial NaiveBayes, with its scaling of features by their
deviation, centred by their mean, and its optimizers: L-BFGS with a search by the strong Wolfe conditions, and for the SVMs OWL-QN, which
keeps a step within its orthant. Spark reads the rows anew for each model and step.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from contextlib import contextmanager
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from trialforge.functions.terms import BLOCK, DOCS, Counts, blocks_of

# Spark's defaults: the tolerance, the steps remembered; the sums that the driver takes at once; and the blocks that Python is sent at once.
TOLERANCE, REMEMBERED, AT_ONCE, SENT = 1e-6, 10, 64, 8

Answer = tuple[float, np.ndarray]


class Failed(Exception):
    """A search along a direction found no step."""


def _direction(grad: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Down the gradient as the remembered steps and changes of the gradient, latest first, bend it."""
    to, scale, factors = grad.copy(), 1.0, []
    if history:
        step, change = history[0]
        scale = (step @ change) / (change @ change)
        if not scale >= 0:
            raise Failed
    for step, change in history:
        factors.append((step @ to) / (step @ change))
        if np.isnan(factors[-1]):
            raise Failed
        to -= factors[-1] * change
    to *= scale
    for (step, change), a in zip(reversed(history), reversed(factors)):
        to += (a - (change @ to) / (step @ change)) * step
    return -to


def _between(low: tuple, high: tuple) -> float:
    """The least of the cubic through two points (t, value, slope), not too near to either."""
    (a, fa, da), (b, fb, db) = sorted((low, high))
    d1 = da + db - 3 * (fa - fb) / (a - b)
    with np.errstate(invalid="ignore"):
        d2 = np.sqrt(d1 * d1 - da * db)
    t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
    return a + 0.1 * (b - a) if t < a + 0.1 * (b - a) else a + 0.9 * (b - a) if t > a + 0.9 * (b - a) else t


def _wolfe(x: np.ndarray, value: float, grad: np.ndarray, to: np.ndarray, first: bool) -> Generator[np.ndarray, Answer, tuple]:
    """A step that meets the strong Wolfe conditions."""
    start = low = (0.0, value, float(grad @ to))
    if start[2] > 0:
        raise Failed
    t, high = 1.0 / np.linalg.norm(to) if first else 1.0, None
    for i in range(20):
        if high is None and i == 10:
            break
        if high is not None:
            if zooms == 10:
                break
            zooms += 1
            t = _between(low, high)
        at = x + t * to
        f, g = yield at
        here = (t, f, float(g @ to))
        if high is None and not np.isfinite(f):
            t /= 2
            continue
        if f > value + 1e-4 * t * start[2] or (f >= low[1] and (high is not None or i > 0)):
            high, zooms = here, 0 if high is None else zooms
            continue
        if abs(here[2]) <= 0.9 * abs(start[2]):
            if t * np.linalg.norm(grad) < 1e-10:
                raise Failed
            return at, f, g
        if high is not None:
            if here[2] * (high[0] - low[0]) >= 0:
                high = low
            low = here
        elif here[2] >= 0:
            low, high, zooms = here, low, 0
        else:
            low = here
            t *= 1.5
    raise Failed


def _backtracking(x: np.ndarray, value: float, grad: np.ndarray, to: np.ndarray, first: bool) -> Generator[np.ndarray, Answer, tuple]:
    """A step, found by shrinking and growing, that stays in the orthant of x or, where x is 0, of its descent. As in Breeze the search
    begins with the first length shrunk, whatever its value, and takes the 19th if none before it will do."""
    orthant = np.where(x != 0, np.sign(x), np.sign(-grad))
    slope, t = float(grad @ to), 0.05 / np.linalg.norm(grad) if first else 0.5
    if not slope < 0:
        raise Failed
    for left in reversed(range(19)):
        at = x + t * to
        at *= np.sign(at) == orthant
        f, g = yield at
        now = float(g @ to)
        if f > value + t * slope * 1e-4 or (now >= 0.9 * slope and now > -0.9 * slope):
            t *= 0.1 if first else 0.5
        elif now < 0.9 * slope:
            t *= 2.1
        else:
            return at, f, g
        if left == 0:
            return at, f, g
        if not 1e-10 <= t <= 1e10:
            raise Failed


def steps(x: np.ndarray, most: int, orthants: bool) -> Generator[np.ndarray, Answer, np.ndarray]:
    """Yields the points at which it needs value and gradient; returns where it ends, after `most` steps or fewer."""
    value, grad = yield x
    history: list[tuple[np.ndarray, np.ndarray]] = []
    n, failed = 0, False
    while n < most and np.linalg.norm(grad) > max(TOLERANCE * abs(value), 1e-8):
        try:
            to = _direction(grad, history)
            if orthants:
                to = np.where(to * grad < 0, to, 0.0)
            at, f, g = yield from (_backtracking if orthants else _wolfe)(x, value, grad, to, n == 0)
        except Failed:
            if failed:
                break
            history, failed = [], True
            continue
        history = [(at - x, g - grad), *history][:REMEMBERED]
        x, value, grad, n, failed = at, f, g, n + 1, False
    return x


class Blocks:
    """Rows of counts as dense cells, in one buffer that is used again."""

    def __init__(self, size: int):
        self.size, self.cells = size, np.zeros((DOCS, size))

    def filled(self, n: int, of: np.ndarray, places: np.ndarray, uses: np.ndarray) -> np.ndarray:
        cells = self.cells[:n]
        cells.fill(0.0)
        cells.ravel()[of * self.size + places] = uses
        return cells


def _packed(counts: Counts):
    """labels, lengths, places, uses, scales: a row of bytes for each block of rows (label and counts)."""
    read, narrow = counts.reader(), np.uint16 if len(counts.kept) <= 1 << 16 else np.uint32

    def run(batches):
        for batch in batches:
            for (labels,), counted in blocks_of(batch, 1):
                n = len(labels)
                of, places, uses, _, _, norm = read(*counted, n)
                made = [labels.to_numpy(zero_copy_only=False).astype(np.int32), np.bincount(of, minlength=n).astype(np.uint32), places.astype(narrow), uses.astype(np.min_scalar_type(int(uses.max(initial=0)))), 1.0 / norm]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], names=PACKED)

    return run, narrow


PACKED = ["labels", "lengths", "places", "uses", "scales"]


def _blocks(batches, size: int, narrow) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, cells and the scale of each part of each row."""
    made = Blocks(size)
    for batch in batches:
        for labels, lengths, places, uses, scales in zip(*[[memoryview(x.as_buffer()) for x in batch.column(i)] for i in range(5)]):
            labels, lengths, places, scales = np.frombuffer(labels, np.int32), np.frombuffer(lengths, np.uint32), np.frombuffer(places, narrow), np.frombuffer(scales)
            uses = np.frombuffer(uses, f"u{len(uses) // max(1, len(places))}" if len(places) else np.uint8)
            n = len(labels)
            yield labels, made.filled(n, np.repeat(np.arange(n), lengths), places, uses), scales.reshape(n, -1)


def _one_row(total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _moments(counts: Counts, narrow, classes: int):
    """Sums of the unweighted cells of each label, and sums of their squares."""
    size, bounds = len(counts.kept), counts.bounds

    def run(batches):
        total = np.zeros((classes + 1, size))
        for labels, cells, scales in _blocks(batches, size, narrow):
            of = np.zeros((classes, len(labels)))
            of[labels, np.arange(len(labels))] = 1.0
            for i, (a, b) in enumerate(bounds):
                total[:classes, a:b] += (of * scales[:, i]) @ cells[:, a:b]
                total[classes, a:b] += (scales[:, i] ** 2) @ (cells[:, a:b] ** 2)
        yield _one_row(total)

    return run


class Model(NamedTuple):
    """Columns `start` to `end` of the margins and their loss: softmax of all labels, logistic or hinge of one against the rest."""

    loss: str
    start: int
    end: int
    label: int


def _margins(cells: np.ndarray, scales: np.ndarray, bounds, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    made = np.tile(bias, (len(cells), 1))
    for i, (a, b) in enumerate(bounds):
        made += scales[:, i, None] * (cells[:, a:b] @ weights[a:b])
    return made


def _told(model: Model, margins: np.ndarray, labels: np.ndarray) -> Answer:
    """The loss of the rows and its slope by their margins."""
    z = margins[:, model.start : model.end]
    if model.loss == "softmax":
        rows, top = np.arange(len(z)), z.max(axis=1)
        e = np.exp(z - top[:, None])
        s = e.sum(axis=1)
        slope = e / s[:, None]
        slope[rows, labels] -= 1.0
        return float(np.sum(np.log(s) - (z[rows, labels] - top))), slope
    of = (labels == model.label)[:, None]
    if model.loss == "logistic":
        return float(np.sum(np.logaddexp(0.0, np.where(of, -z, z)))), 1.0 / (1.0 + np.exp(-z)) - of
    sign = np.where(of, 1.0, -1.0)
    short = 1.0 - sign * z
    return float(short[short > 0].sum()), np.where(short > 0, -sign, 0.0)


def _slopes(counts: Counts, narrow, models: list[Model], weights: np.ndarray, bias: np.ndarray):
    """Slopes of the losses by the unscaled weights, then by the bias, then the losses at the models' first columns."""
    size, bounds = len(counts.kept), counts.bounds

    def run(batches):
        total = np.zeros((size + 2, len(bias)))
        for labels, cells, scales in _blocks(batches, size, narrow):
            margins = _margins(cells, scales, bounds, weights, bias)
            slope = np.empty_like(margins)
            for m in models:
                loss, slope[:, m.start : m.end] = _told(m, margins, labels)
                total[size + 1, m.start] += loss
            for i, (a, b) in enumerate(bounds):
                total[a:b] += cells[:, a:b].T @ (scales[:, i, None] * slope)
            total[size] += slope.sum(axis=0)
        yield _one_row(total)

    return run


def _added(batches):
    total = None
    for batch in batches:
        for x in batch.column(0):
            own = np.frombuffer(x.as_buffer())
            total = own if total is None else total + own
    if total is not None:
        yield _one_row(total)


def _total(parts: DataFrame, n: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the arrays of `n` partitions."""
    if n > AT_ONCE:
        parts = parts.repartition(isqrt(n)).mapInArrow(_added, "sums binary")
    total = np.zeros(shape)
    for r in parts.toLocalIterator() if n > AT_ONCE**2 else parts.collect():
        total += np.frombuffer(bytes(r["sums"])).reshape(shape)
    return total


class Fitted(NamedTuple):
    """Weights and bias by the unscaled cells; of each kind of model the first and last column, and the labels that its columns stand for."""

    weights: np.ndarray
    bias: np.ndarray
    kinds: dict[str, tuple[int, int, list[int]]]


@contextmanager
def _kept(blocks: DataFrame) -> Iterator[None]:
    """Blocks are kept to be read again and again, and Python is sent a few at once: Spark's ten thousand rows are a whole partition of
    blocks, for which Python would wait."""
    conf, key = blocks.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, SENT)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        blocks.unpersist()
        conf.set(key, before)


def fitted(counts: Counts, label: str, reg: float = 0.01, logistic_steps: int = 20, svm_steps: int = 10) -> Fitted:
    """The models of the rows of `_fit`: logistic, svm, bayes. Their labels are whole numbers from 0."""
    rows = counts.table.where("_fit")
    n_of = {int(r[label]): r["n"] for r in rows.select(F.explode(label).alias(label)).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n_of:
        raise ValueError("no rows to fit a classifier on")
    size, n, classes, seen = len(counts.kept), sum(n_of.values()), max(n_of) + 1, sorted(n_of)
    if len(seen) == 1:
        return Fitted(np.zeros((size, 3)), np.zeros(3), {k: (i, i + 1, seen) for i, k in enumerate(("logistic", "svm", "bayes"))})
    pack, narrow = _packed(counts)
    blocks = rows.select(label, *BLOCK).mapInArrow(pack, ", ".join(f"{c} binary" for c in PACKED))
    tasks, cores = blocks.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    if cores < tasks < 4 * cores:
        # parts of unlike size in two or three goes leave cores idle at each step
        tasks = 2 * cores
        blocks = blocks.repartition(tasks)
    with _kept(blocks):
        idf = counts.idf[counts.kept]
        moments = _total(blocks.mapInArrow(_moments(counts, narrow, classes), "sums binary"), tasks, (classes + 1, size))
        by_label = moments[:classes] * idf
        mean = by_label.sum(axis=0) / n
        deviation = np.sqrt(np.maximum(moments[classes] * idf**2 - n * mean**2, 0.0) / max(1, n - 1))
        scale = np.divide(1.0, deviation, out=np.zeros(size), where=deviation > 0)
        centre = mean * scale

        # of two labels one column is enough
        wide, first = (classes, np.log1p([n_of.get(y, 0) for y in range(classes)])) if classes > 2 else (1, np.log([n_of[1] / n_of[0]]))
        asked = [("softmax" if classes > 2 else "logistic", wide, 1, steps(np.r_[np.zeros(size * wide), first - (first.mean() if classes > 2 else 0)], logistic_steps, False))]
        asked += [("hinge", 1, y, steps(np.zeros(size + 1), svm_steps, True)) for y in range(classes)]
        points, ends = {i: next(x[3]) for i, x in enumerate(asked)}, {}
        while points:
            models, at = [], 0
            for i in points:
                loss, width, y, _ = asked[i]
                models.append(Model(loss, at, at + width, y))
                at += width
            scaled = np.hstack([p.reshape(size + 1, -1) for p in points.values()])
            weights, bias = scaled[:size] * (scale * idf)[:, None], scaled[size] - centre @ scaled[:size]
            sums = _total(blocks.mapInArrow(_slopes(counts, narrow, models, weights, bias), "sums binary"), tasks, (size + 2, at))
            slopes = sums[: size + 1] / n
            slopes[:size] = slopes[:size] * (scale * idf)[:, None] - np.outer(centre, slopes[size]) + reg * scaled[:size]
            for (i, p), m in zip(list(points.items()), models):
                w = scaled[:size, m.start : m.end]
                try:
                    points[i] = asked[i][3].send((sums[size + 1, m.start] / n + 0.5 * reg * float(np.sum(w * w)), slopes[:, m.start : m.end].ravel()))
                except StopIteration as end:
                    ends[i] = end.value.reshape(size + 1, -1)
                    del points[i]
    scaled = np.hstack([ends[i] for i in range(len(asked))])
    weights, bias = scaled[:size] * (scale * idf)[:, None], scaled[size] - centre @ scaled[:size]
    if classes == 2:
        weights, bias = np.hstack([np.zeros((size, 1)), weights]), np.r_[0.0, bias]
    chance = np.log(by_label[seen] + 1.0) - np.log(by_label[seen].sum(axis=1) + size)[:, None]
    prior = np.log(np.array([n_of[y] for y in seen]) + 1.0) - np.log(n + len(seen))
    every = list(range(classes))
    kinds = {"logistic": (0, classes, every), "svm": (classes, 2 * classes, every), "bayes": (2 * classes, 2 * classes + len(seen), seen)}
    return Fitted(np.hstack([weights, chance.T * idf[:, None]]), np.r_[bias, prior], kinds)


def guesses(counts: Counts, model: Fitted, rows: DataFrame, rest: list[str]) -> DataFrame:
    """kind, the columns `rest` and prediction: a row for each of the rows in `rows`, blocks of the counts, and kind of model."""
    read, size, bounds, parts = counts.reader(), len(counts.kept), counts.bounds, counts.parts
    kept = len(rest)

    def run(batches):
        made = Blocks(size)
        for batch in batches:
            for own, counted in blocks_of(batch, kept):
                n = len(own[0])
                of, places, uses, _, _, norm = read(*counted, n)
                margins = _margins(made.filled(n, of, places, uses), 1.0 / norm.reshape(-1, parts), bounds, model.weights, model.bias)
                for kind, (a, b, labels) in model.kinds.items():
                    guess = np.array(labels, np.int32)[margins[:, a:b].argmax(axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), *own, pa.array(guess)], names=["kind", *rest, "prediction"])

    schema = StructType([StructField("kind", StringType()), *[StructField(c, rows.schema[c].dataType.elementType) for c in rest], StructField("prediction", IntegerType())])
    return rows.select(*rest, *BLOCK).mapInArrow(run, schema)
