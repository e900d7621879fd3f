"""Folders for what a run writes on its way: one that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or (in tests, in one process) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="tessella-shared-"))
        at = f"file://{_own_folder[0]}"
    return at.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of an operator."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_text(spark: SparkSession, at: str, content: str) -> str:
    """One small file of a given name; returns it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(content.encode()))
    out.close()
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again with the same schema."""
    at = work_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
