"""How many tasks a scan gives to work that costs much more than reading."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """df over a few partitions a core if its scan gives less than one to each core, else as it is.

    A scan cuts its files into one part a core as long as a part is worth opening, so it gives fewer where the optimizer's size of
    the data is below that for all cores. Such a table is small, and so is its shuffle; a large one has partitions enough and isn't moved.
    Nothing is run to find out.
    """
    session = df.sparkSession
    cores = session.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    worth = session._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    return df.repartition(cores * per_core) if size < cores * worth else df
