"""Document quality: base rules and a hashed n-gram likelihood ratio, all in the plan.

Texts are cut into runs of letters and digits and runs of other visible characters; these tokens
and their neighbouring pairs are hashed into BUCKETS. Two multinomials over the buckets are
counted, one over all documents (raw) and one over trusted documents (labelled quality 1). A
document's score is the mean over its n-grams of log p(trusted) / p(raw); it is kept if it passes
the base rules and the score is at least the threshold. The trusted counts are drawn towards the
raw ones by PRIOR pseudo-counts, so buckets without evidence say nothing.

TRUSTED_ROWS bounds the trusted sample (lowest hashes of doc_id among quality 1); everything else
covers all rows. Edge cases: a null text has no words and fails; texts are judged whole, however long; with
no trusted documents all scores are 0 and only the base rules decide; repeated rows and labels are
judged and counted once each; rows of equal hash are drawn by doc_id, so ties have one order; the
columns that judge returns (BASE, llr, kept) replace ones of these names, all others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.runtime import quoted, table

BUCKETS = 1 << 13
PRIOR = 8192.0
TRUSTED_ROWS = 4096
THRESHOLD = -0.25
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, use) -> Column:
    """use(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated(words: Column) -> Column:
    """Words that lie in windows of three words found twice or more."""

    def windows(w: Column, of) -> Column:
        count = F.size(w) - 2
        made = F.transform(F.slice(w, 1, F.greatest(count, F.lit(0))), lambda x, i: of(x, F.get(w, i + 1), F.get(w, i + 2)))
        return made

    def marked(v: Column) -> Column:
        order = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda x, i: (x["v"] == F.get(s, i - 1)["v"]) | (x["v"] == F.get(s, i + 1)["v"])
            return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

        # Each window adds the words that the one before it has not covered: three at most.
        covered = lambda d: F.aggregate(F.transform(d, lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get(d, i - 1), F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return let(let(order, twins), covered)

    # Hashes that all differ show that nothing repeats; else the windows themselves are compared (words hold no blanks).
    by_value = let(windows(words, lambda *w: F.concat_ws(" ", *w)), marked)
    return let(windows(words, F.xxhash64), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(by_value)).cast("long")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def base_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    df = df.drop(*BASE)
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    held = free_name(df, "_words")
    words = F.col(quoted(held))
    df = df.withColumn(held, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": let(words, repeated),
        }
    ).drop(held)
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """Log-likelihood ratio of each bucket; what comes to the driver has BUCKETS rows."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows).withColumn("_good", F.lit(1))
    rows = docs.select("doc_id", tokens(F.col("text")).alias("w")).join(F.broadcast(good), "doc_id", "left")
    rows = rows.select("w", F.coalesce("_good", F.lit(0)).alias("good"), F.posexplode("w").alias("i", "x"))
    pair = F.when(F.col("i") + 1 < F.size("w"), bucket(F.col("x"), F.get("w", F.col("i") + 1)))
    rows = rows.select("good", F.explode(F.array(bucket(F.col("x")), pair)).alias("b")).where("b IS NOT NULL")
    counts = {r.b: (r.good, r.raw) for r in rows.groupBy("b").agg(F.sum("good").alias("good"), F.count("*").alias("raw")).collect()}
    raw, trusted = sum(c[1] for c in counts.values()), sum(c[0] for c in counts.values())
    out = []
    for b in range(BUCKETS):
        g, r = counts.get(b, (0, 0))
        p = (r + 1) / (raw + BUCKETS)
        out.append(math.log((g + PRIOR * p) / (trusted + PRIOR) / p) if trusted else 0.0)
    return out


def score(df: DataFrame, ratios: list[float], text: str = "text", name: str = "llr") -> DataFrame:
    """df with the mean log-likelihood ratio of a text's n-grams (0 for none)."""
    wall = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def total(w: Column) -> Column:
        each = lambda x, i: F.get(wall, bucket(x)) + F.when(i + 1 < F.size(w), F.get(wall, bucket(x, F.get(w, i + 1)))).otherwise(F.lit(0.0))
        return F.aggregate(F.transform(w, each), F.lit(0.0), lambda a, x: a + x) / (2 * F.size(w) - 1)

    return df.withColumn(name, let(tokens(F.col(text)), lambda w: F.when(F.size(w) > 0, total(w)).otherwise(F.lit(0.0))))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """docs with the base rules' columns, llr and kept."""
    docs = docs.drop(*BASE, "llr", "kept")
    ratios = fit(docs.select("doc_id", "text"), labels, trusted_rows)
    return score(base_rules(docs), ratios).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality verdict on every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", *BASE, "kept", "llr")
