"""Samples that any engine can draw again: by the order of a hash of seed and id; chunks and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def stratum(n: Column) -> Column:
    """By the number of records: none, one or two, three to five, more."""
    return F.when(n == 0, "zero").when(n <= 2, "few").when(n <= 5, "medium").otherwise("many")


def stratified(df: DataFrame, key: str, records: str, n: int, seed: int = 42) -> DataFrame:
    """A share of each stratum, at least one; topped up from the rest and cut at n. Adds stratum.

    No more than the n first drawn of a stratum can be taken, so only these are ranked.
    """
    rows = df.withColumn("stratum", stratum(F.col(records))).withColumn("_draw", draw(F.col(key), seed))
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_total", F.sum("_size").over(Window.partitionBy(F.lit(0))))  # four rows at most
    quota = sizes.select("stratum", F.least("_size", F.greatest(F.lit(1), F.floor(F.col("_size") / F.col("_total") * n))).alias("_quota"))
    first = [rows.where(F.col("stratum") == x).orderBy("_draw", key).limit(n) for x in ("zero", "few", "medium", "many")]
    few = first[0].unionByName(first[1]).unionByName(first[2]).unionByName(first[3])
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy("stratum").orderBy("_draw", key))).join(F.broadcast(quota), "stratum")
    place = F.when(F.col("stratum") == "zero", 0).when(F.col("stratum") == "few", 1).when(F.col("stratum") == "medium", 2).otherwise(3)
    first = F.when(F.col("_rank") <= F.col("_quota"), place).otherwise(4)
    return ranked.withColumn("_first", first).orderBy("_first", "_draw", key).limit(n).select(*df.columns, "stratum")


def chunked(df: DataFrame, by: list[str], order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Numbers rows into chunks of at most size, from 0, within each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def default_pairs(taxa: Column) -> Column:
    return 4 * taxa


def spaced(pages: Column, skip: int = 2, most: int = 10) -> Column:
    """Indices of the pages to look at: all but the first skip of a longer document, at most most of them evenly spaced."""
    start = F.when(pages > 4, skip).otherwise(0)
    rest = pages - start
    every = F.when(rest > 0, F.sequence(start.cast("int"), (pages - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (start + F.floor(i * rest / most)).cast("int")))
    return F.when(rest <= most, every).otherwise(some)
