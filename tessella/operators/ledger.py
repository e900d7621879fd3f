"""Ledgers: receipts against rows, monthly supplements, budgets, precedents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.numbering import in_sequence

# The codes of entertainment expenses.
ENTERTAINMENT = (6455, 6460, 6470, 6475)


def reconciled(receipts: DataFrame, rows: DataFrame, number: str) -> DataFrame:
    """(number, status): receipts no row names, and rows' numbers without a receipt. Several rows may share one."""
    side = lambda df, paper: df.select(number, F.lit(paper).alias("_a"), F.lit(not paper).alias("_b")).where(F.col(number).isNotNull())
    met = side(receipts, True).unionByName(side(rows, False)).groupBy(number).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))
    return met.where("NOT (_a AND _b)").select(number, F.when(F.col("_a"), "orphaned_receipt").otherwise("missing_file").alias("status"))


def next_number(df: DataFrame, number: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def numbered_after(new: DataFrame, order: list[str], last: int, name: str = "receipt_seq") -> DataFrame:
    """New receipts numbered on from the highest number there is."""
    return in_sequence(new, order, name, last + 1).withColumn(name, F.col(name).cast("int"))


def precedent(df: DataFrame, by: str, value: str) -> DataFrame:
    """What a vendor's rows mostly say; of equally frequent values the least."""
    votes = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    best = Window.partitionBy(by).orderBy(F.desc("n"), value)
    return votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(by, F.col(value).alias("precedent"), F.col("n").alias("times"))


def entertainment(code: Column) -> Column:
    return F.coalesce(code.cast("int").isin(*ENTERTAINMENT), F.lit(False))


def supplement(df: DataFrame, month: Column, by: list[str], cost: str) -> DataFrame:
    """Costs by month and by, with a total row for each month (by null) and one over all."""
    rows = df.select(month.alias("month"), *by, F.col(cost).alias("_c"))
    sets = [[F.col("month"), *map(F.col, by)], [F.col("month")], []]
    return rows.groupingSets(sets, F.col("month"), *map(F.col, by)).agg(F.sum("_c").alias("total"), F.count("*").alias("n_rows"))


def budget_flags(spend: DataFrame, budget: DataFrame, by: str, spent: str, allowed: str) -> DataFrame:
    """What is left of each budget, and whether it is overdrawn; spending without a budget counts against 0."""
    sums = spend.groupBy(by).agg(F.sum(spent).alias("spent"))
    both = sums.join(budget.select(by, F.col(allowed).alias("budget")), by, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(by, zero("spent").alias("spent"), zero("budget").alias("budget"), (zero("budget") - zero("spent")).alias("left"), (zero("spent") > zero("budget")).alias("over"))


def file_class(df: DataFrame, digest: str, order: str, readable: Column, receipt: Column) -> DataFrame:
    """normal, duplicate (its content came before), non_receipt or unreadable."""
    nth = F.row_number().over(Window.partitionBy(digest).orderBy(order))
    return df.withColumn("_n", nth).withColumn("file_class", F.when(~readable, "unreadable").when(F.col("_n") > 1, "duplicate").when(~receipt, "non_receipt").otherwise("normal")).drop("_n")


def pipe_row(columns: list[Column]) -> Column:
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
