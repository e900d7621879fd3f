"""What the operators here share: shipping the package, shared folders, table paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shipping import ship
from tessella.sources.scratch import remove, shared_folder, stored, work_folder

__all__ = ["Tables", "numbered", "pack", "quoted", "remove", "shared_folder", "ship", "shuffle_width", "stored", "table", "unpack", "work_folder"]


class Tables:
    """Tables in the shared folder that an operator writes on its way and drops as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As stored; drop(name) removes it."""
        at = work_folder(self.spark, name)
        df.write.parquet(at)
        self.at[name] = at
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for n in names:
            remove(self.spark, self.at.pop(n))


def quoted(name: str) -> str:
    """A column's name as it may be given to F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1 and so on (whatever characters their names have), and what names are called there."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), [at[n] for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct, so that no name of theirs can clash."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = F.struct(*(F.col(quoted(c)) for c in rest)) if rest else F.struct(F.lit(None).cast("int").alias("nothing"))
    return docs.select("doc_id", "text", held.alias("_rest"))


def unpack(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like from what pack made of it."""
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in like.columns))
