"""Telling the language of texts by character n-grams; the profiles are fitted on texts whose language is known.

A text's words (runs of letters, lower case) stand between marks and are cut into n-grams of one to
three characters. A profile holds, for each language's most frequent n-grams, how likely they are in
every language. All figures are whole numbers (thousandths of a logarithm), so that sums do not depend
on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import or_blank, words_in
from tessella.sources.scratch import stored

SIZES = (1, 2, 3)
MOST = 1500
LEAST_CHARS = 40
MOST_LANGUAGES = 200


def grams(word: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """All n-grams of a word between marks."""
    marked = F.concat(F.lit("_"), word, F.lit("_"))
    cut = lambda n: F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substr(marked, i, F.lit(n)))).otherwise(F.array())
    return F.concat(*(cut(n) for n in sizes))


def fit(df: DataFrame, text: str, language: str, most: int = MOST, sizes: tuple[int, ...] = SIZES) -> tuple[list[str], DataFrame]:
    """The languages, and the profile: gram and its weights in the order of the languages.

    Distinct words are counted first, so n-grams are cut once a word and language. The profile has at
    most `most` rows for each language; languages are collected (MOST_LANGUAGES at most).
    """
    known = df.where(F.col(language).isNotNull()).select(F.col(language).alias("lang"), F.explode(words_in(F.col(text))).alias("word"))
    words = stored(known.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")  # all figures below come from these, so texts are read once
    counts = words.select("lang", "n", F.explode(grams(F.col("word"), sizes)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    names = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # an alphabet's n-grams, not the texts
    held = counts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select("gram").distinct()
    size = F.length("gram").alias("size")
    totals = counts.groupBy("lang", size).agg(F.sum("n").alias("total"))
    kinds = held.groupBy(size).agg(F.count("*").alias("kinds"))
    rows = held.withColumn("size", F.length("gram")).join(F.broadcast(totals.join(kinds, "size")), "size").join(counts, ["lang", "gram"], "left")
    weight = F.round(1000 * F.log((F.coalesce("n", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * F.col("kinds")))).cast("long")
    by = rows.groupBy("gram").pivot("lang", names).agg(F.first(weight)) if names else held
    return names, by.select("gram", F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names)).alias("weights"))


def told(df: DataFrame, key: str, text: str, languages: list[str], profile: DataFrame, least: int = LEAST_CHARS, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """key and told: the likeliest language of each row of distinct keys; null for texts under least characters or without a known n-gram.

    Of equally likely languages the first by name is told. The profile is broadcast (its size is bounded by fit).
    """
    if not languages:
        return df.select(key, F.lit(None).cast("string").alias("told"))
    rows = df.where(F.length(F.trim(or_blank(F.col(text)))) >= least).select(key, F.explode(words_in(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    # What a word says is the same in all texts, so it is cut and looked up once; texts meet words, not n-grams.
    met = rows.select("word").distinct().select("word", F.explode(grams(F.col("word"), sizes)).alias("gram")).join(F.broadcast(profile), "gram")
    words = met.groupBy("word").agg(*(F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(len(languages))))
    sums = rows.join(words, "word").groupBy(key).agg(*(F.sum(F.col("n") * F.col(f"w{i}")).alias(f"_{i}") for i in range(len(languages))))
    best = F.array_max(F.array(*(F.struct(F.col(f"_{i}").alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("told")) for i, n in enumerate(languages))))
    made = sums.select(key, best["told"].alias("told"))
    return df.select(key).join(made, key, "left")
