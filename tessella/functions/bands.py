"""Quality bands: thresholds with names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(value: Column, steps: list[tuple[float, str]], below: str | None, strict: bool = True) -> Column:
    """The name of the first step that value exceeds (or reaches), steps falling; null stays null."""
    out = None
    for edge, name in steps:
        test = (value > edge) if strict else (value >= edge)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(value.isNotNull(), F.lit(below))


def completeness(percent: Column) -> Column:
    return F.when(percent > 95, "excellent").when(percent >= 90, "good").when(percent >= 85, "acceptable").when(percent >= 70, "questionable").when(percent.isNotNull(), "poor")


def fragmentation(percent: Column) -> Column:
    return F.when(percent < 5, "excellent").when(percent <= 10, "good").when(percent.isNotNull(), "fragmented")


def duplication(percent: Column) -> Column:
    return F.when(percent < 2, "excellent").when(percent <= 5, "good").when(percent <= 10, "elevated").when(percent.isNotNull(), "contaminated")


def trimming(percent: Column) -> Column:
    return F.when(percent < 10, "excellent").when(percent < 20, "good").when(percent < 35, "moderate").when(percent <= 50, "poor").when(percent.isNotNull(), "exclude")


def contiguity(n50: Column) -> Column:
    return F.when(n50 > 10e6, "excellent").when(n50 > 1e6, "good").when(n50 < 100e3, "poor").when(n50.isNotNull(), "fair")


def support(delta: Column) -> Column:
    """How a model with this difference to the least information criterion is supported."""
    return F.when(delta < 2, "equivalent").when(delta <= 7, "considerably less").when(delta <= 10, "little").when(delta.isNotNull(), "none")
