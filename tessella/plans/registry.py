"""What a query is here: a function of (spark, folder of tables), known by its name, with the SQL that it equals."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        CATALOGUE[name or f.__name__] = run, sql
        return f

    return keep


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def joined(c, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
