"""The k nearest rows of each row within a tolerance, in time that does not depend on how dense a place is.

Equal points are one point first. The points of the right side lie in cells; a cell with more than
`most` points is cut into four, and so on (a quad-tree by counts). Points of the left side go down the tree
together: at each level a point keeps only the cells that can hold one of its k nearest, as told by
the cells' own boxes and counts. So a point meets a few cells of `most` points, however many lie within the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.scratch import stored

MOST = 64
DEEPEST = 40
SALTS = 64


def first_rows(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The k first rows of each group, found in parts before a group meets."""
    salted = Window.partitionBy(*by, F.pmod(F.xxhash64(*order), F.lit(SALTS))).orderBy(*order)
    some = df.withColumn("_k", F.row_number().over(salted)).where(F.col("_k") <= k)
    return some.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def box_distance(x: Column, y: Column, far: bool) -> Column:
    """From a point to the nearest or the farthest place of a cell's box."""
    side = lambda c, low, high: F.greatest(F.abs(c - low), F.abs(c - high)) if far else F.greatest(low - c, c - high, F.lit(0.0))
    return F.sqrt(F.pow(side(x, F.col("x0"), F.col("x1")), 2) + F.pow(side(y, F.col("y0"), F.col("y1")), 2))


class Tree:
    """Cells of points (px, py, n) by level; cells: ix, iy, leaf, rows and box. leaves: the points with their cell."""

    def __init__(self, points: DataFrame, size: float, most: int):
        self.size, self.levels, parts = size, [], []
        rest = points
        for level in range(DEEPEST + 1):
            rest = rest.withColumn("ix", cell(F.col("px"), size, level)).withColumn("iy", cell(F.col("py"), size, level))
            box = [F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")]
            cells = rest.groupBy("ix", "iy").agg(F.count("*").alias("points"), F.sum("n").alias("rows"), *box)
            full = (F.col("points") > most) & (F.lit(level) < DEEPEST)
            cells = stored(cells.withColumn("leaf", ~full).drop("points"), f"cells-{level}")
            self.levels.append(cells)
            hot = cells.where("NOT leaf").select("ix", "iy")
            if not hot.head(1):
                parts.append(rest.withColumn("level", F.lit(level)))
                break
            parts.append(rest.join(hot, ["ix", "iy"], "left_anti").withColumn("level", F.lit(level)))
            rest = stored(rest.join(hot, ["ix", "iy"], "left_semi").select("px", "py", "n"), f"points-{level}")
        self.leaves = parts[0]
        for p in parts[1:]:
            self.leaves = self.leaves.unionByName(p)


def cell(c: Column, size: float, level: int) -> Column:
    return F.floor(c / F.lit(size) * F.lit(float(1 << level)))


def reachable(front: DataFrame, k: int, tolerance: float) -> DataFrame:
    """The cells of each point that can hold one of its k nearest: those not beyond the distance within which k rows surely lie."""
    by = Window.partitionBy("lx", "ly")
    front = front.withColumn("near", box_distance(F.col("lx"), F.col("ly"), False)).withColumn("far", box_distance(F.col("lx"), F.col("ly"), True))
    front = front.where(F.col("near") <= tolerance).withColumn("held", F.sum("rows").over(by.orderBy("far").rangeBetween(Window.unboundedPreceding, 0)))
    front = front.withColumn("bound", F.min(F.when(F.col("held") >= k, F.col("far"))).over(by))
    return front.where(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).drop("near", "far", "held", "bound")


def nearest(left: DataFrame, right: DataFrame, x: str, y: str, k: int, tolerance: float, tie: list[str] | None = None, most: int = MOST) -> DataFrame:
    """left.* and right.* as structs l and r, with distance: the k nearest of the right side for each left row, none beyond tolerance.

    tie: columns of the right side that decide between equally near rows, so that k stay; None: all
    that are as near as the k-th stay. Rows without a place have no partner. Jobs run while the plan is made.
    """
    place = lambda df, name, a, b: df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(F.struct(*df.columns).alias(name), (F.col(x).cast("double") + 0.0).alias(a), (F.col(y).cast("double") + 0.0).alias(b))
    a, b = place(left, "l", "lx", "ly"), place(right, "r", "px", "py")
    if tie is not None:
        order = [f"_t{i}" for i in range(len(tie))]
        b = first_rows(b.select("*", *(F.col(f"r.{c}").alias(o) for c, o in zip(tie, order, strict=True))), ["px", "py"], order, k)
    b = stored(b, "places")
    points = stored(b.groupBy("px", "py").agg(F.count("*").alias("n")), "points")
    tree = Tree(points, 2 * tolerance, most)
    step = F.sequence(F.lit(-1), F.lit(1))
    around = a.select("lx", "ly").distinct().withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    around = around.select("lx", "ly", (cell(F.col("lx"), tree.size, 0) + F.col("dx")).alias("ix"), (cell(F.col("ly"), tree.size, 0) + F.col("dy")).alias("iy"))
    front = reachable(around.join(tree.levels[0], ["ix", "iy"]).withColumn("level", F.lit(0)), k, tolerance)
    for level, cells in enumerate(tree.levels[1:], 1):
        up = cells.withColumn("px", F.floor(F.col("ix") / 2)).withColumn("py", F.floor(F.col("iy") / 2)).withColumn("level", F.lit(level))
        inner = front.where("NOT leaf").select("lx", "ly", F.col("ix").alias("px"), F.col("iy").alias("py"))
        front = stored(reachable(front.where("leaf").unionByName(inner.join(up, ["px", "py"]).drop("px", "py")), k, tolerance), f"front-{level}")
    met = front.select("lx", "ly", "level", "ix", "iy").join(tree.leaves, ["level", "ix", "iy"])
    distance = F.sqrt(F.pow(F.col("lx") - F.col("px"), 2) + F.pow(F.col("ly") - F.col("py"), 2))
    met = met.withColumn("distance", distance).where(F.col("distance") <= tolerance)
    by = Window.partitionBy("lx", "ly")
    within = F.sum("n").over(by.orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)) - F.sum("n").over(Window.partitionBy("lx", "ly", "distance"))
    met = met.withColumn("_nearer", within).where(F.col("_nearer") < k).select("lx", "ly", "px", "py", "distance").join(b, ["px", "py"])
    if tie is not None:
        met = met.withColumn("_k", F.row_number().over(by.orderBy("distance", *order))).where(F.col("_k") <= k)
    return a.join(met.select("lx", "ly", "r", "distance"), ["lx", "ly"]).select("l", "r", "distance")
