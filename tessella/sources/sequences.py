"""Sequence files, trees and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shipping import ship
from tessella.sources.split import records, with_heads


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, seq) of FASTA files; sequences over several lines are joined."""
    raw = spark.read.option("lineSep", ">").text(path).select("value", F.input_file_name().alias("path")).where(F.trim("value") != "")
    header = F.trim(F.substring_index("value", "\n", 1))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return raw.select("path", header.alias("header"), F.upper(body).alias("seq"))


def fasta_faults(df: DataFrame, by: list[str], taxon: str = "header", seq: str = "seq") -> DataFrame:
    """Repeated taxa, forbidden characters, empty sequences and unequal lengths: (by, taxon, fault)."""
    times = df.groupBy(*by, taxon).agg(F.count("*").alias("n")).where("n > 1").select(*by, taxon, F.lit("duplicate taxon").alias("fault"))
    bad = df.where(~F.col(seq).rlike(r"^[A-Z*?-]*$")).select(*by, taxon, F.lit("forbidden character").alias("fault"))
    empty = df.where(F.col(seq) == "").select(*by, taxon, F.lit("empty").alias("fault"))
    longest = df.groupBy(*by).agg(F.max(F.length(seq)).alias("_most"))
    uneven = (df.join(longest, by) if by else df.crossJoin(longest)).where(F.length(seq) != F.col("_most")).select(*by, taxon, F.lit("length").alias("fault"))
    return times.unionByName(bad).unionByName(empty).unionByName(uneven)


def regrouped(fasta: DataFrame) -> DataFrame:
    """(locus, species, seq): the locus before the header's first underscore, the species from the file's name."""
    species = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return fasta.select(F.substring_index("header", "_", 1).alias("locus"), species.alias("species"), "seq")


def fasta_text(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def read_partition_info(spark: SparkSession, path: str) -> DataFrame:
    """(locus, start, end) behind two header lines; lines of fewer than three fields are left out. A file is read in splits."""
    rows = with_heads(records(spark, path, "\n"))
    lines = rows.where("block > 0 OR at > head + 1").select(F.regexp_replace("value", r"\r$", "").alias("line"))
    parts = F.split("line", "\t")
    return lines.where(F.size(parts) >= 3).select(F.trim(parts[0]).alias("locus"), F.trim(parts[1]).cast("int").alias("start"), F.trim(parts[2]).cast("int").alias("end"))


def newick_tips(tree: Column) -> Column:
    """Names before a colon, or if there are none, before a comma or closing bracket."""
    with_lengths = F.array_distinct(F.regexp_extract_all(tree, F.lit(r"([A-Za-z0-9_.-]+):"), F.lit(1)))
    bare = F.array_distinct(F.regexp_extract_all(tree, F.lit(r"([A-Za-z0-9_.-]+)\s*(?=[,)])"), F.lit(1)))
    return F.when(F.size(with_lengths) > 0, with_lengths).otherwise(bare)


def newick_nodes(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, node, parent, depth, label) of each tree's nodes, numbered in the order in which they open."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for k, text in zip(b[key], b[tree], strict=True):
                stack, count, at = [], 0, 0
                text = (text or "").strip().rstrip(";")
                label = ""
                last = None
                while at < len(text):
                    c = text[at]
                    if c == "(":
                        count += 1
                        rows.append([k, count, stack[-1] if stack else None, len(stack), ""])
                        stack.append(count)
                        last = None
                        at += 1
                    elif c in ",)":
                        if c == ")":
                            last = stack.pop() if stack else None
                        else:
                            last = None
                        at += 1
                    else:
                        end = at
                        while end < len(text) and text[end] not in "(),":
                            end += 1
                        label = text[at:end].split(":")[0].strip()
                        if last is not None:
                            next(r for r in reversed(rows) if r[0] == k and r[1] == last)[4] = label
                        elif label:
                            count += 1
                            rows.append([k, count, stack[-1] if stack else None, len(stack), label])
                        at = end
            yield pd.DataFrame(rows, columns=[key, "node", "parent", "depth", "label"]).astype({"node": "Int64", "parent": "Int64", "depth": "Int64"})

    ship(df.sparkSession)
    return df.select(key, tree).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, node long, parent long, depth long, label string")


def read_quality_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(genome, s, d, f, m): counts behind the comma of the lines S:, D:, F: and M: of each folder's summary; a missing line is 0."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), "value")
    kind = F.regexp_extract("value", r"^\s*([SDFM]):", 1)
    count = F.regexp_extract("value", r"^\s*[SDFM]:[^,]*,\s*(\d+)", 1).try_cast("long")
    rows = lines.select(F.element_at(F.split("path", "/"), -2).alias("genome"), kind.alias("k"), count.alias("n")).where("k <> ''")
    return rows.groupBy("genome").agg(*(F.coalesce(F.max(F.when(F.col("k") == x, F.col("n"))), F.lit(0)).alias(x.lower()) for x in "SDFM"))


def read_matrix(spark: SparkSession, path: str) -> dict[str, float]:
    """A substitution matrix in the usual text form (a line of letters, then a line for each), as pair_scores takes it; # starts a comment."""
    lines = [r.value.split() for r in spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n")).alias("value")).collect() if r.value.strip() and not r.value.startswith("#")]
    letters = lines[0]
    return {min(a, row[0]) + max(a, row[0]): float(x) for row in lines[1:] for a, x in zip(letters, row[1:], strict=True)}
