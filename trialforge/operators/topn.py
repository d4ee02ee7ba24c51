"""The N best of every group by one global sort.

Rows are range-partitioned on group, score and identifier, so a group of any size is spread over as many partitions as it fills
and tasks stay equal. Each partition counts its groups; the counts, prefix-summed in the order of the partitions, give every row
its exact position in its group, and positions up to N are kept. A row beyond place N of its group within its own partition
can't be among them and leaves the partition's output at once.

Defined results: rows with a null or blank group are left out, as are scores that are null or no finite numbers; -0.0 equals 0.0;
equal scores are ordered by identifier in byte order, and a row repeated with equal group, score and identifier counts once; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trialforge.functions.lineage import materialize
from trialforge.functions.text import folded, present


def top_n(rows: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """group, rank_no and ident of the n rows of each group with the highest score."""
    # score - score is 0 for finite numbers only
    flat = rows.select(F.col(group).cast("string").alias("g"), (F.col(score) + F.lit(0.0)).alias("s"), F.col(ident).cast("string").alias("i")).where(F.col("g").isNotNull() & F.col("i").isNotNull() & (F.col("s") - F.col("s") == 0.0))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = flat.repartitionByRange(parts, F.col("g"), F.col("s").desc(), F.col("i")).sortWithinPartitions("g", F.col("s").desc(), "i")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["part", "g", "i", "place", "n"]
        last, seen, last_id = None, 0, None

        def count(g: pa.Array, k: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), part, dtype=np.int32)), g, pa.nulls(len(g), pa.string()), pa.nulls(len(g), pa.int64()), pa.array(k, pa.int64())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            g, i = batch.column(0), batch.column(2)
            size = batch.num_rows
            starts = np.ones(size, dtype=bool)
            starts[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
            starts[0] = g[0].as_py() != last
            # sorted by (group, score, identifier), so a repeated row follows its first
            repeat = np.zeros(size, dtype=bool)
            repeat[1:] = ~starts[1:] & pc.equal(i[1:], i[:-1]).to_numpy(zero_copy_only=False)
            repeat[0] = not starts[0] and i[0].as_py() == last_id
            fresh = np.cumsum(~repeat)
            at = np.flatnonzero(starts)
            base = np.where(starts, fresh - 1, 0)
            place = fresh - np.maximum.accumulate(base) + np.where(np.cumsum(starts) == 0, seen, 0)
            keep = pa.array(np.flatnonzero((place <= n) & ~repeat))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), part, dtype=np.int32)), g.take(keep), i.take(keep), pa.array(place[keep.to_numpy()].astype(np.int64)), pa.nulls(len(keep), pa.int64())], names)
            if len(at):
                # groups that ended in this batch: the one carried over, and all that began but the last
                carried = [] if last is None else [seen + int(fresh[at[0] - 1]) if at[0] else seen]
                ended = pa.concat_arrays([pa.array([last] * len(carried), pa.string()), g.take(pa.array(at[:-1])).cast(pa.string())])
                yield count(ended, np.concatenate([np.array(carried, dtype=np.int64), place[at[1:] - 1].astype(np.int64)]))
            last, seen, last_id = g[size - 1].as_py(), int(place[size - 1]), i[size - 1].as_py()
        if last is not None:
            yield count(pa.array([last], pa.string()), np.array([seen], dtype=np.int64))

    # rows and counts must come from one run of the sort, as another might cut the ranges elsewhere
    out, _ = materialize(ordered.mapInArrow(work, "part int, g string, i string, place bigint, n bigint"), "ranges")
    before = out.where("n is not null").select("g", "part", (F.sum("n").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    kept = out.where("place is not null").join(before, ["g", "part"], "left")
    place = F.col("place") + F.coalesce("before", F.lit(0).cast("long"))
    return kept.select(F.col("g").alias(group), place.alias("rank_no"), F.col("i").alias(ident)).where(F.col("rank_no") <= n)


def current_rows(candidates: DataFrame) -> DataFrame:
    """Each candidate's dated row with the latest updated_at, then the highest seq: candidate_id, family, selection_eval."""
    dated = candidates.where(present("candidate_id") & (F.col("updated_at") >= F.col("created_at")))
    best = dated.groupBy(folded("candidate_id").alias("candidate_id")).agg(F.max_by(F.struct(folded("family").alias("family"), "selection_eval"), F.struct("updated_at", "seq")).alias("x"))
    return best.select("candidate_id", "x.*")


def lab_top(candidates: DataFrame, n: int = 3) -> DataFrame:
    """The n best candidates of every family by selection_eval."""
    return top_n(current_rows(candidates).where(present("family")), "family", "selection_eval", "candidate_id", n)
