"""Dealing rows by ranges of a key whose bounds do not depend on the order of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(df: DataFrame, key: str, parts: int, per_part: int = 40, most: int = 1 << 17) -> list:
    """parts - 1 rising bounds from the per_part * parts rows (at most most) of lowest hash: the one bounded sample, it moves rows between tasks but changes no result."""
    columns = [F.col(c) for c in df.columns]
    got = df.where(F.col(key).isNotNull()).select(key, F.xxhash64(*columns).alias("_h")).orderBy("_h", key).limit(min(most, per_part * parts)).collect()
    values = sorted(r[0] for r in got)
    return [values[len(values) * i // parts] for i in range(1, parts)] if values else []


def place(key: Column, at: list, inclusive: bool = True) -> Column:
    """How many bounds lie at or below key (inclusive) or below it, by binary search in the plan; 0 for null."""
    if not at:
        return F.lit(0)
    wall = F.array(*map(F.lit, at))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(at).bit_length()))))

    def climb(low: Column, step: Column) -> Column:
        middle = F.get(wall, low + step - 1)
        return F.when((low + step <= len(at)) & ((middle <= key) if inclusive else (middle < key)), low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), climb)
