"""What services have answered, kept for all runs: a table of keys that only grows by successes.

Each run appends a folder of its own, whole or not at all, so runs may go on side by side; of a key
that two runs have asked for the later answer counts. fold() writes all answers, one row a key, into
one folder and names the folders that it stands for in a file that is put in place last; readers take the newest
such folder and every other one that it doesn't name. What has been folded goes with the fold after the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import write_text

MOST_FOLDERS = 32


class Lookups:
    """The answers of one service under a folder; schema: the fields of an answer."""

    def __init__(self, spark: SparkSession, at: str, schema: str):
        self.spark, self.at, self.schema = spark, at.rstrip("/"), schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(at).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self, pattern: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.globStatus(self.path(f"{self.at}/{pattern}")) or [])

    def folds(self) -> list[tuple[int, str, set[str]]]:
        """Number, folder and what it stands for of each fold that is in place, oldest first."""
        out = []
        for name in self.listed("fold-*.names"):
            names = {r.value for r in self.spark.read.text(f"{self.at}/{name}").collect() if r.value}  # MOST_FOLDERS or so
            base = next(n for n in names if n.startswith("base-"))
            out.append((int(name[5:-6]), base, names - {base}))
        return out

    def folders(self) -> list[str]:
        """The folders that hold all answers."""
        folds = self.folds()
        gone = set().union(*(names for _, _, names in folds))
        runs = [r for r in self.listed("run-*") if r not in gone and self.fs.exists(self.path(f"{self.at}/{r}/_SUCCESS"))]
        return [*([folds[-1][1]] if folds else []), *runs]

    def known(self) -> DataFrame:
        """key, the answer's fields and when it was given; one row a key."""
        columns = f"key string, {self.schema}, answered timestamp"
        folders = [f"{self.at}/{f}" for f in self.folders()]
        if not folders:
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(columns).parquet(*folders)
        return rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), F.struct("answered", F.xxhash64(*rows.columns))).alias("r")).select("r.*")

    def add(self, found: DataFrame) -> None:
        """Append answers (key and fields)."""
        found.withColumn("answered", F.current_timestamp()).write.parquet(f"{self.at}/run-{uuid.uuid4().hex}")
        if len(self.folders()) > MOST_FOLDERS:
            self.fold()

    def fold(self) -> None:
        folds, folders = self.folds(), self.folders()
        number = folds[-1][0] + 1 if folds else 1
        base = f"base-{uuid.uuid4().hex}"
        self.known().write.parquet(f"{self.at}/{base}")
        runs = [f for f in folders if f.startswith("run-")]
        hidden = write_text(self.spark, f"{self.at}/.fold-{uuid.uuid4().hex}", "\n".join([base, *runs]) + "\n")
        if not self.fs.rename(self.path(hidden), self.path(f"{self.at}/fold-{number:06d}.names")):  # another run has folded meanwhile
            self.fs.delete(self.path(f"{self.at}/{base}"), True)
            return
        for _, old, names in folds[:-1]:
            for name in [*names, old]:
                self.fs.delete(self.path(f"{self.at}/{name}"), True)
