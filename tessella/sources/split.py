"""Text files as records that end with a mark, read in splits: a large file is the work of many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """file, block (where its split begins), at (rises within a block) and value: what lies between two marks."""
    rows = spark.read.option("lineSep", mark).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def with_heads(rows: DataFrame) -> DataFrame:
    """records with head: the place of the file's first one."""
    heads = rows.where("block = 0").groupBy("file").agg(F.min("at").alias("head"))  # one row a file
    return rows.join(F.broadcast(heads), "file")


def numbered_records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """records with n, their number in the file from 0: places in a block and the counts of the blocks before it, of which there is one row each."""
    rows = records(spark, path, mark)
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.withColumn("_own", own).join(F.broadcast(before), ["file", "block"]).withColumn("n", F.col("_before") + F.col("_own") - 1).drop("_own", "_before")
