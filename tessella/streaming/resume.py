"""Work that is resumed: only what has no result yet, results kept at once, failures tried again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shipping import ship
from tessella.operators.numbering import in_sequence

Call = Callable[[dict], dict]


def called(df: DataFrame, call: Call, schema: str, tries: int = 3, wait: float = 1.0, pause: float = 0.0, rate: float | None = None, tasks: int = 4) -> DataFrame:
    """df's rows through an external call; status is success or error.

    A call that raises OSError is tried again after growing waits; pause keeps the calls of one task
    apart. rate bounds the calls a second of the whole job: the rows are dealt to so many tasks
    (tasks), each of which keeps tasks / rate seconds between its calls, retries included.
    """
    if rate:
        df, pause = df.repartition(tasks), max(pause, tasks / rate)
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                made, error = None, None
                for k in range(tries):
                    try:
                        made = call(row)
                        break
                    except OSError as e:
                        error = str(e)
                        time.sleep(max(pause, wait * 2**k))
                    except ValueError as e:
                        error = str(e)
                        break
                if pause:
                    time.sleep(pause)
                out.append({**row, **{n: (made or {}).get(n) for n in names}, "status": "success" if made is not None else "error", "error": None if made is not None else error})
            yield pd.DataFrame(out, columns=[*b.columns, *names, "status", "error"], dtype=object)

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    ship(df.sparkSession)
    return df.mapInPandas(run, f"{own}, {schema}, status string, error string")


def resume(todo: DataFrame, results: str, key: str, call: Call, schema: str, **options) -> DataFrame:
    """Append results for the keys that have no success yet; failures are not kept, so the next run tries them again."""
    spark = todo.sparkSession
    done = known(spark, results)
    left = todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")
    called(left, call, schema, **options).where("status = 'success'").drop("error").write.mode("append").parquet(results)
    return spark.read.parquet(results)


def known(spark: SparkSession, results: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(results)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(results) if fs.exists(path) and fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{results}/*.parquet")) else None


def windows_of(df: DataFrame, order: list[str], per_batch: int = 5, per_window: int = 4) -> DataFrame:
    """Number of the batch and of the window of batches in which each row is sent."""
    n = F.col("_place")
    rows = in_sequence(df, order, "_place", 0)
    return rows.withColumns({"batch": F.floor(n / per_batch).cast("int"), "send_window": F.floor(n / (per_batch * per_window)).cast("int")}).drop("_place")
