"""Comparing extracted values with the truth: counts, precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import collapsed

COUNTS = "struct<tp:int,fp:int,fn:int>"


def counts(tp, fp, fn) -> Column:
    whole = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(whole(tp).alias("tp"), whole(fp).alias("fp"), whole(fn).alias("fn"))


def boolean_counts(predicted: Column, truth: Column) -> Column:
    """Equal (also both false): a hit; only predicted: a false alarm; only true: a miss."""
    same = F.equal_null(predicted, truth)
    yes, no = F.coalesce(predicted, F.lit(False)), F.coalesce(truth, F.lit(False))
    return F.when(same, counts(1, 0, 0)).when(yes & ~no, counts(0, 1, 0)).when(~yes & no, counts(0, 0, 1)).otherwise(counts(0, 0, 0))


def same_number(predicted: Column, truth: Column, tolerance: float = 0.0) -> Column:
    return F.when(predicted.isNull() | truth.isNull(), predicted.isNull() & truth.isNull()).otherwise(F.abs(predicted - truth) <= tolerance)


def same_text(predicted: Column, truth: Column, fuzzy: bool = True) -> Column:
    a, b = (F.when(c.isNotNull(), collapsed(c)) for c in (predicted, truth)) if fuzzy else (predicted, truth)
    return F.equal_null(a, b)


def match_counts(match: Column) -> Column:
    """A mismatch is both a false alarm and a miss."""
    return F.when(match, counts(1, 0, 0)).otherwise(counts(0, 1, 1))


def empty_counts(predicted: Column) -> Column:
    """For a truth that is null: nothing predicted is a hit."""
    return F.when(predicted.isNull() | (predicted.cast("string") == "") | (predicted.cast("string") == "[]"), counts(1, 0, 0)).otherwise(counts(0, 1, 0))


def list_counts(predicted: Column, truth: Column) -> Column:
    """As sets; null is empty."""
    none = F.array().cast("array<string>")
    norm = lambda c: F.array_distinct(F.transform(F.coalesce(c.cast("array<string>"), none), lambda x: collapsed(x)))
    a, b = norm(predicted), norm(truth)
    return counts(F.size(F.array_intersect(a, b)), F.size(F.array_except(a, b)), F.size(F.array_except(b, a)))


def ordered_counts(predicted: Column, truth: Column) -> Column:
    """By position; only a difference in length counts against, as the method has it."""
    none = F.array().cast("array<string>")
    a, b = (F.coalesce(c.cast("array<string>"), none) for c in (predicted, truth))
    common = F.least(F.size(a), F.size(b))
    hits = F.size(F.filter(F.zip_with(F.slice(a, 1, common), F.slice(b, 1, common), lambda x, y: collapsed(x) == collapsed(y)), lambda x: x))
    return counts(hits, F.greatest(F.lit(0), F.size(a) - F.size(b)), F.greatest(F.lit(0), F.size(b) - F.size(a)))


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def with_metrics(df: DataFrame, digits: int = 6) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return df.withColumns({"precision": F.round(precision(tp, fp), digits), "recall": F.round(recall(tp, fn), digits), "f1": F.round(f1(tp, fp, fn), digits)})


def field_pairs(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both sides' fields: (keys, predicted, truth), missing ones null."""
    p = predicted.select(*keys, F.col("value").alias("predicted"))
    return p.join(truth.select(*keys, F.col("value").alias("truth")), keys, "full")


def by_field_and_overall(df: DataFrame, field: str) -> DataFrame:
    """Summed counts for each field and for all together (field 'overall'), with metrics: micro-averages."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    both = df.groupingSets([[F.col(field)], []], F.col(field)).agg(*sums, F.grouping(field).alias("_all"))
    return with_metrics(both.withColumn(field, F.when(F.col("_all") == 1, "overall").otherwise(F.col(field))).drop("_all"))


def weak_fields(metrics: DataFrame, field: str, limit: float = 0.7) -> DataFrame:
    return metrics.where((F.col(field) != "overall") & (F.least("precision", "recall") < limit)).orderBy("recall", "precision", field)


def report_line(field: Column, tp: Column, fp: Column, fn: Column, p: Column, r: Column, f: Column) -> Column:
    return F.concat(F.rpad(field, 30, " "), *(F.lpad(x.cast("string"), 7, " ") for x in (tp, fp, fn)), *(F.lpad(F.format_string("%.1f%%", x * 100), 9, " ") for x in (p, r, f)))
