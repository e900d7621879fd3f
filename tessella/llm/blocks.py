"""Documents in blocks that keep their texts at home while small messages travel.

A block is a group of documents of about BLOCK_BYTES, dealt by a hash of the row and of the task that
reads it, so that rows equal in all (many without an id, say) are spread as well. Steps that need
knowledge of the whole corpus send messages from each block to the owners of keys and get replies
back by block; a block then works its texts through once more, with the replies. The exchange that
deals the texts is one and the same in each step of a plan, so Spark runs it once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.runtime import remove, shuffle_width, work_folder

BLOCK_BYTES = 6 << 20
#: Stands for a null doc_id, which so counts as larger than all others.
NULL_ID = (1 << 63) - 1


class Blocks:
    """The documents of a table, dealt into blocks."""

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
        self.width = shuffle_width(docs.sparkSession)
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        self.count = max(1, -(-total // block_bytes))
        self.owners = max(self.width, self.count)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(self.count)).cast("int")
        self.rows = rows.withColumn("block", block).repartition(self.width, "block")

    def each(self, step: Callable, schema: str) -> DataFrame:
        """step(block's table) for each block."""
        return self.rows.groupBy("block").applyInArrow(step, schema)

    def answer(self, replies: DataFrame, step: Callable, schema: str) -> DataFrame:
        """step(block's table, its replies) for each block; blocks without replies get an empty table."""
        return self.rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(step, schema)


def texts_of(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and UTF-8 texts of a block in an order that does not depend on how rows arrived."""
    ids = [NULL_ID if x is None else x for x in table.column("doc_id").to_pylist()]
    texts = [b"" if x is None else x for x in table.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return np.array([ids[i] for i in order], dtype=np.int64), [texts[i] for i in order]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: equal inputs only give equal outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each begins (with the array's length at the end)."""
    if not len(values):
        return values, np.zeros(1, dtype=np.int64)
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[heads], np.r_[heads, len(values)]


class StoredBlocks:
    """Blocks in a table in the shared folder that is bucketed by block, so that any number of jobs read them without moving texts.

    A block's rows come from one task of the scan: writing moves nothing between executors.
    """

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
        spark = docs.sparkSession
        self.width = shuffle_width(spark)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        tasks = max(1, docs.rdd.getNumPartitions())
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        each = max(1, -(-total // (tasks * block_bytes)))
        self.owners = max(self.width, tasks * each)
        # The table is written once, so a running number deals rows that are equal in all.
        block = F.spark_partition_id() * each + F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(each)).cast("int")
        name, self.folder = f"blocks_{uuid.uuid4().hex}", work_folder(spark, "blocks")
        docs.withColumn("block", block).write.bucketBy(self.width, "block").option("path", self.folder).option("compression", "zstd").saveAsTable(name)
        self.rows = spark.table(name)
        self.rows.schema  # noqa: B018  resolved here: the files stay when the catalog's entry goes
        spark.sql(f"DROP TABLE {name}")

    each = Blocks.each
    answer = Blocks.answer

    def drop(self) -> None:
        """Remove the table, when nothing reads it any more."""
        remove(self.rows.sparkSession, self.folder)
