"""Connected components of links by alternating stars; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.runtime import Tables


def components(links: DataFrame, tables: Tables | None = None, name: str = "components", a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node and component (the least node that links reach) for each node that a link touches.

    Each round turns every node's links into a star around its least neighbour, first for larger
    and then for smaller neighbours; when nothing changes, all links are (node, least node). Rounds
    grow with the logarithm of the longest path. Null nodes and links to oneself are ignored. The
    result is a table under name in tables; what a round has written goes when the next one is done.
    """
    tables = tables or Tables(links.sparkSession)

    def stars(d: DataFrame, larger: bool, step: str) -> DataFrame:
        # d: (a, b) with a > b. For larger neighbours look from both ends, for smaller ones from a only.
        both = d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else d
        # Written first, so that both sides of the join are plain exchanges and a star's many links can be split between tasks.
        least = tables.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-least-{step}")
        met = both.join(least, "a")
        if larger:
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        return out.where("a > b").distinct()

    d = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    before = None
    for k in range(most_rounds):
        met = stars(tables.keep(stars(d, True, "up"), f"{name}-{k}-met"), False, "down")
        d = tables.keep(met, f"{name}-{k}")
        tables.drop(f"{name}-least-up", f"{name}-least-down", f"{name}-{k}-met", *([f"{name}-{k - 1}"] if k else []))
        now = tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            nodes = d.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(d.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
            out = tables.keep(nodes, name)
            tables.drop(f"{name}-{k}")
            return out
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
