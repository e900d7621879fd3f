"""Numbers in sequence over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import stored


def in_sequence(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """df with the place of each row in an order, from first on.

    Rows are dealt by ranges of the order and written; a task's rows follow those of the tasks
    before it, so only one count for each task is needed to place them all.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = {r["_task"]: r["n"] for r in rows.groupBy("_task").agg(F.count("*").alias("n")).collect()}  # one row a task
    at, before = first, []
    for task in sorted(counts):
        before.append((task, at))
        at += counts[task]
    offsets = df.sparkSession.createDataFrame(before, "_task int, _before long")
    return rows.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_row") + F.col("_before")).drop("_task", "_row", "_before")
