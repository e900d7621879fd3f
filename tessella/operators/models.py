"""Comparing fitted models; presence matrices of species and areas; rule dimensions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.bands import support
from tessella.functions.shipping import ship


def information(lnl: Column, k: Column, n: Column | None = None) -> Column:
    """AIC, or with a sample size its corrected form."""
    aic = 2 * k - 2 * lnl
    return aic if n is None else aic + F.try_divide(2 * k * (k + 1), n - k - 1)


def compared(models: DataFrame, by: list[str], name: str = "model", aic: str = "aic") -> DataFrame:
    """Difference to the best, weight, rank and band of each model."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = w.orderBy(aic, name)
    d = models.withColumn("delta", F.col(aic) - F.min(aic).over(w))
    d = d.withColumn("weight", F.exp(-F.col("delta") / 2) / F.sum(F.exp(-F.col("delta") / 2)).over(w))
    return d.withColumns({"rank": F.row_number().over(order), "support": support(F.col("delta"))})


@F.pandas_udf(T.DoubleType())
def _tail(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(math.sqrt(max(v, 0.0) / 2)))


def chi2_tail(x: Column) -> Column:
    """Upper tail of a chi-square variable with one degree of freedom."""
    ship()
    return _tail(x)


def ratio_tests(models: DataFrame, by: list[str], name: str = "model", lnl: str = "lnl", suffix: str = "+J", with_p: bool = True) -> DataFrame:
    """Each base model against the one with suffix: statistic 2 * difference, p for one degree of freedom."""
    base = models.where(~F.endswith(F.col(name), F.lit(suffix))).select(*by, F.col(name).alias("base"), F.col(lnl).alias("base_lnl"))
    more = models.select(*by, F.col(name).alias("_more"), F.col(lnl).alias("more_lnl"))
    pairs = base.withColumn("_more", F.concat("base", F.lit(suffix))).join(more, [*by, "_more"]).withColumnRenamed("_more", "extended")
    out = pairs.withColumn("statistic", 2 * (F.col("more_lnl") - F.col("base_lnl")))
    return out.withColumn("p", chi2_tail(F.col("statistic"))).withColumn("significant", F.col("p") < 0.05) if with_p else out


def free_parameters(parameters: DataFrame, by: str, kind: str = "type") -> DataFrame:
    return parameters.groupBy(by).agg(F.count_if(F.col(kind) == "free").alias("n_free"))


def state_count(areas: int, most: int, with_null: bool = True) -> int:
    """Ranges of at most so many areas."""
    return sum(math.comb(areas, k) for k in range(0 if with_null else 1, min(most, areas) + 1))


def state_counts(areas: Column, most: Column, with_null: bool = True) -> Column:
    """state_count of columns: ranges of at most `most` of so many areas (binomials one from another)."""
    start = F.struct(F.lit(1).cast("long").alias("binomial"), F.lit(1 if with_null else 0).cast("long").alias("sum"))

    def more(acc: Column, k: Column) -> Column:
        binomial = F.floor(acc["binomial"] * (areas - k + 1) / k).cast("long")
        return F.struct(binomial.alias("binomial"), (acc["sum"] + binomial).alias("sum"))

    upto = F.least(areas, most)
    steps = F.when(upto > 0, F.sequence(F.lit(1), F.greatest(upto, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, more, lambda acc: acc["sum"])


# The model families and what sets each apart.
FAMILIES = {"BAYAREALIKE": {"s": False, "v": False, "y": 1.0}, "DIVALIKE": {"s": False, "v": True, "y": 0.5}, "DEC": {"s": True, "v": True, "y": 1.0}}


def model_options(name: str) -> dict:
    """Family and whether founder events are free."""
    family = next((f for f in FAMILIES if f in name), None)
    if family is None:
        raise ValueError(f"unknown model {name}")
    return {"family": family, "founder": "+J" in name, **FAMILIES[family]}


def options_of(name: Column) -> Column:
    """model_options of a column of names, as a struct; an unknown model raises."""
    out = F.raise_error(F.concat(F.lit("unknown model "), name))
    for family, sets in reversed(FAMILIES.items()):
        told = F.struct(F.lit(family).alias("family"), F.contains(name, F.lit("+J")).alias("founder"), *(F.lit(v).alias(k) for k, v in sets.items()))
        out = F.when(F.contains(name, F.lit(family)), told).otherwise(out)
    return out


PRESENT = ("1", "present", "Present", "TRUE", "True")


def presence(value: Column) -> Column:
    return F.when(F.trim(value).isin(*PRESENT), "1").otherwise("0")


def area_names(n: int) -> list[str]:
    return [chr(65 + i) for i in range(n)]


def presence_rows(df: DataFrame, species: str, areas: list[str]) -> DataFrame:
    """(species, bits): names with underscores, one digit for each area."""
    return df.select(F.regexp_replace(F.trim(species), " ", "_").alias("species"), F.concat(*(presence(F.col(a).cast("string")) for a in areas)).alias("bits"))


def presence_matrix(pairs: DataFrame, species: str, area: str, areas: list) -> DataFrame:
    """Bit string of each species from (species, area) pairs."""
    made = pairs.groupBy(species).agg(F.collect_set(area).alias("_a"))
    return made.select(species, F.concat(*(F.array_contains("_a", a).cast("int").cast("string") for a in areas)).alias("bits"))


def geography_text(rows: DataFrame, areas: list[str]) -> DataFrame:
    """Lines of the matrix file: counts and areas, then species and bits."""
    head = rows.agg(F.concat_ws("\t", F.count("*").cast("string"), F.lit(str(len(areas))), F.lit(f"({' '.join(areas)})")).alias("line")).select(F.lit("").alias("species"), "line")
    return head.unionByName(rows.select("species", F.concat_ws("\t", "species", "bits").alias("line")))


def line_faults(line: Column, areas: Column) -> Column:
    """What is wrong with one species line."""
    parts = F.split(line, "\t", -1)
    name, bits = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    rules = [
        (~F.contains(line, F.lit("\t")), "no tab"),
        (F.contains(line, F.lit("\t")) & (F.size(parts) != 2), "fields"),
        (F.contains(name, F.lit(" ")), "space in name"),
        (F.coalesce(F.length(bits), F.lit(0)) != areas, "length"),
        (~F.coalesce(bits, F.lit("")).rlike("^[01]*$"), "symbols"),
    ]
    return F.filter(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules)), lambda x: x.isNotNull())


def name_differences(species: DataFrame, tips: DataFrame, name: str) -> DataFrame:
    """(name, missing_in): species the tree lacks and tips the matrix lacks; nothing if there are no tips."""
    s, t = species.select(name).distinct(), tips.select(name).distinct()
    any_tip = t.limit(1).select(F.lit(1).alias("_one"))
    a = s.join(t, name, "left_anti").join(F.broadcast(any_tip)).drop("_one").withColumn("missing_in", F.lit("tree"))
    return a.unionByName(t.join(s, name, "left_anti").withColumn("missing_in", F.lit("matrix")))


# Marker lineages with clade, number of markers and the lineage they lie in.
LINEAGES = (
    ("eukaryota_odb10", "All eukaryotes", 255, None),
    ("bacteria_odb10", "All bacteria", 124, None),
    ("archaea_odb10", "All archaea", 194, None),
    ("metazoa_odb10", "Animals", 954, "eukaryota_odb10"),
    ("viridiplantae_odb10", "Green plants", 425, "eukaryota_odb10"),
    ("fungi_odb10", "Fungi", 758, "eukaryota_odb10"),
    ("arthropoda_odb10", "Arthropods", 1013, "metazoa_odb10"),
    ("insecta_odb10", "Insects", 1367, "arthropoda_odb10"),
    ("diptera_odb10", "Flies", 3285, "insecta_odb10"),
    ("hymenoptera_odb10", "Bees, wasps, ants", 5991, "insecta_odb10"),
    ("lepidoptera_odb10", "Moths, butterflies", 5286, "insecta_odb10"),
    ("arachnida_odb10", "Spiders, mites", 2934, "arthropoda_odb10"),
    ("vertebrata_odb10", "Vertebrates", 3354, "metazoa_odb10"),
    ("actinopterygii_odb10", "Ray-finned fish", 3640, "vertebrata_odb10"),
    ("mammalia_odb10", "Mammals", 9226, "vertebrata_odb10"),
    ("aves_odb10", "Birds", 8338, "vertebrata_odb10"),
    ("mollusca_odb10", "Molluscs", 5295, "metazoa_odb10"),
    ("nematoda_odb10", "Roundworms", 3131, "metazoa_odb10"),
    ("eudicots_odb10", "Eudicots", 2326, "viridiplantae_odb10"),
    ("liliopsida_odb10", "Monocots", 3278, "viridiplantae_odb10"),
    ("embryophyta_odb10", "Land plants", 1614, "viridiplantae_odb10"),
    ("ascomycota_odb10", "Ascomycetes", 1706, "fungi_odb10"),
    ("basidiomycota_odb10", "Basidiomycetes", 1335, "fungi_odb10"),
)
# Substitution models to try, by breadth and number of taxa (least, most), best first.
MODEL_SETS = (
    ("deep", 51, 1_000_000, ("LG+F+G4", "WAG+F+G4", "LG4X", "Q.pfam+F+G4", "JTT+F+G4")),
    ("moderate", 20, 50, ("LG+F+G4", "WAG+F+G4", "JTT+F+G4", "Q.pfam+F+G4")),
    ("shallow", 0, 19, ("LG+F+G4", "WAG+F+G4", "JTT+F+G4")),
)
CLADE_MODELS = (("birds", "Q.bird+F+G4"), ("mammals", "Q.mammal+F+G4"), ("insects", "Q.insect+F+G4"), ("plants", "Q.plant+F+G4"), ("fungi", "Q.yeast+F+G4"))


def ancestors(spark) -> DataFrame:
    """(lineage, ancestor, steps) for each lineage and all that it lies in, itself included."""
    parent = {name: up for name, _, _, up in LINEAGES}
    rows = []
    for name in parent:
        at, steps = name, 0
        while at:
            rows.append((name, at, steps))
            at, steps = parent[at], steps + 1
    return spark.createDataFrame(rows, "lineage string, ancestor string, steps int")


def recommended(df: DataFrame, taxa: str) -> DataFrame:
    """df with one row for each model to try at its number of taxa, ranked."""
    rules = df.sparkSession.createDataFrame([(b, lo, hi, i + 1, m) for b, lo, hi, ms in MODEL_SETS for i, m in enumerate(ms)], "breadth string, low long, high long, position int, model string")
    return df.join(F.broadcast(rules), (F.col(taxa) >= F.col("low")) & (F.col(taxa) <= F.col("high"))).drop("low", "high")
