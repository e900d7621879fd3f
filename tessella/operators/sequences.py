"""Alignments: column patterns, pair scores over windows, resampled cutoffs, distances, trees, trimming, joining."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import windows
from tessella.functions.joining import joined_tree
from tessella.functions.shipping import ship
from tessella.operators import pairwise
from tessella.operators.wildcards import redundant

# The nucleotides each ambiguity letter stands for.
AMBIGUITY = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
PURINES, PYRIMIDINES = "AG", "CT"
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
WINDOW = 6


def even_window(w: int | None) -> int:
    w = WINDOW if w is None else w
    return w + w % 2


def even_width(w: Column) -> Column:
    """even_window of a column."""
    given = F.coalesce(w.cast("int"), F.lit(WINDOW))
    return given + given % 2


def columns_of(df: DataFrame, by: list[str], taxon: str, seq: str) -> DataFrame:
    """One row for each symbol: (by, taxon, pos, ch), positions from 0."""
    return df.select(*by, taxon, F.posexplode(F.filter(F.split(F.upper(seq), ""), lambda c: c != "")).alias("pos", "ch"))


def sequence_type(seq: Column) -> Column:
    """nt, RY or aa by the share of letters."""
    s = F.regexp_replace(F.upper(seq), r"[-?NX*\s]", "")
    share = lambda letters: F.try_divide(F.length(F.regexp_replace(s, f"[^{letters}]", "")), F.length(s))
    return F.when(share("ACGTU") > 0.8, "nt").when(share("RY") > 0.8, "RY").otherwise("aa")


def recoded(seq: Column, kind: str) -> Column:
    """Upper case, unknown and stop symbols as the type's unknown letter."""
    return F.translate(F.upper(seq), "?*", "NN" if kind == "nt" else "XX")


def site_patterns(cells: DataFrame, by: list[str]) -> DataFrame:
    """Distinct symbols of each column, and whether it is invariant (one symbol, no gap or unknown)."""
    made = cells.groupBy(*by, "pos").agg(F.countDistinct("ch").alias("n_states"), F.count_if(F.col("ch").isin("N", "-", "X", "?")).alias("n_unknown"))
    return made.withColumn("invariant", (F.col("n_states") == 1) & (F.col("n_unknown") == 0))


def runs(df: DataFrame, by: list[str], pos: str, flag: Column, least: int = 1) -> DataFrame:
    """Maximal runs of neighbouring positions that satisfy flag: (by, start, end, length)."""
    w = Window.partitionBy(*by).orderBy(pos)
    hit = df.where(flag).select(*by, pos, (F.col(pos) - F.row_number().over(w)).alias("_g"))
    made = hit.groupBy(*by, "_g").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("length"))
    return made.where(F.col("length") >= least).drop("_g")


def skipped_sections(invariant_runs: DataFrame, w: int = WINDOW) -> DataFrame:
    """Of runs of 2w - 2 or more, what scoring leaves out: all but w - 1 columns at each end."""
    return invariant_runs.where(F.col("length") >= 2 * w - 2).withColumns({"skip_start": F.col("start") + w - 1, "skip_end": F.col("end") - w + 1}).where("skip_end >= skip_start")


def pairs(df: DataFrame, by: list[str], taxon: str, seq: str) -> DataFrame:
    """Unordered pairs of taxa of one locus: (by, a, seq_a, b, seq_b), dealt over all tasks by pairs of blocks of taxa."""
    met = pairwise.pairs(df.select(*by, F.col(taxon).alias("t"), F.col(seq).alias("s")), by)
    return met.select(*by, F.col("x.t").alias("a"), F.col("x.s").alias("seq_a"), F.col("y.t").alias("b"), F.col("y.s").alias("seq_b"))


def outgroup_pairs(df: DataFrame, by: list[str], taxon: str, seq: str, outgroup: list[str]) -> DataFrame:
    both = pairs(df, by, taxon, seq)
    inside = lambda c: F.col(c).isin(*outgroup)
    return both.where(inside("a") != inside("b"))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches by the positions that both know; unknown on either side leaves a position out."""
    x, y = F.split(F.upper(a), ""), F.split(F.upper(b), "")
    known = lambda c: ~c.isin("N", "-", "X", "?", "")
    cells = F.filter(F.zip_with(x, y, lambda p, q: F.when(known(p) & known(q), F.when(p == q, 0).otherwise(1))), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(cells, F.lit(0), lambda s, v: s + v), F.size(cells))


def net_divergence(distances: DataFrame, by: list[str]) -> DataFrame:
    ends = distances.select(*by, F.explode(F.array("a", "b")).alias("taxon"), "distance")
    return ends.groupBy(*by, "taxon").agg(F.sum("distance").alias("divergence"))


def closest_pair(distances: DataFrame, by: list[str]) -> DataFrame:
    """The pair that neighbour joining picks first: least distance relative to both divergences."""
    r = net_divergence(distances, by)
    n = r.groupBy(*by).agg(F.count("*").alias("n"))
    d = distances.join(r.select(*by, F.col("taxon").alias("a"), F.col("divergence").alias("ra")), [*by, "a"]).join(r.select(*by, F.col("taxon").alias("b"), F.col("divergence").alias("rb")), [*by, "b"])
    d = (d.join(n, by) if by else d.crossJoin(n)).withColumn("relative", F.round(F.col("distance") - F.try_divide(F.col("ra") + F.col("rb"), F.col("n") - 2), 9))
    w = Window.partitionBy(*by).orderBy("relative", "a", "b")
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "a", "b", "distance", "relative")


def trees(distances: DataFrame, by: str) -> DataFrame:
    """One neighbour-joining tree for each locus from its (a, b, distance) rows."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["a"]) | set(rows["b"]))
        at = {x: i for i, x in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        for a, b, x in zip(rows["a"], rows["b"], rows["distance"], strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = x
        return pd.DataFrame({by: [rows[by].iloc[0]], "newick": [joined_tree(names, d)]})

    ship(distances.sparkSession)
    return distances.groupBy(by).applyInPandas(grow, f"{by} {distances.schema[by].dataType.simpleString()}, newick string")


def window_sums(cells: DataFrame, by: list[str], pos: str, score: str, w: int = WINDOW) -> DataFrame:
    """Sum of the w scores from each position on, where w are left, and its sign spread over them."""
    ahead = Window.partitionBy(*by).orderBy(pos).rowsBetween(0, w - 1)
    rows = cells.withColumn("window_sum", F.when(F.count("*").over(ahead) == w, F.sum(score).over(ahead)))
    return rows


def spread(rows: DataFrame, by: list[str], pos: str, threshold: Column, w: int = WINDOW) -> DataFrame:
    """site_score: +1 for each window over a position whose sum exceeds the threshold, -1 for each other one."""
    behind = Window.partitionBy(*by).orderBy(pos).rowsBetween(-(w - 1), 0)
    sign = F.when(F.col("window_sum").isNull(), 0).when(F.col("window_sum") > threshold, 1).otherwise(-1)
    return rows.withColumn("_s", sign).withColumn("site_score", F.sum("_s").over(behind)).drop("_s")


def pair_histogram(df: DataFrame, by: list[str], taxon: str, seq: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(by, pos, score, n): how many pairs of taxa of a locus have a score (of two letters, in either order) at a position that both have.

    Letters of a column are counted and the counts multiplied, so the pairs aren't made. Rows of one
    taxon are no pair: what they would add is counted in the same way, and taken off.
    """

    cells = lambda rows, key: rows.select(*key, F.posexplode(F.filter(F.split(F.upper(seq), ""), lambda c: c != "")).alias("pos", "ch"))

    def counted(rows: DataFrame, key: list[str]) -> DataFrame:
        own = cells(rows, key).groupBy(*key, "pos", "ch").agg(F.count("*").alias("n"))
        met = own.join(own.select(*key, "pos", F.col("ch").alias("other"), F.col("n").alias("m")), [*key, "pos"]).where("ch <= other")
        number = F.when(F.col("ch") == F.col("other"), F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("m"))
        return met.select(*by, "pos", score(F.col("ch"), F.col("other")).alias("score"), number.alias("n"))

    rows = df.select(*by, taxon, seq).where(F.col(taxon).isNotNull())
    twice = rows.groupBy(*by, taxon).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = counted(rows.join(twice, [*by, taxon]), [*by, taxon]).withColumn("n", -F.col("n"))
    return counted(rows, by).unionByName(again).groupBy(*by, "pos", "score").agg(F.sum("n").alias("n")).where("n > 0")


def median_profile(scores: DataFrame, by: list[str], pos: str, score: str, w: int = WINDOW, n: str | None = None) -> DataFrame:
    """Median over pairs by window length, and the strict profile (-1 if any pair is below 0). n: how many pairs a row stands for.

    Equal scores are counted first, so a task holds a position's different scores only.
    """
    counts = scores.groupBy(*by, pos, score).agg((F.sum(n) if n else F.count("*")).alias("_n"))
    return counts.groupBy(*by, pos).agg(F.round(F.percentile(score, 0.5, F.col("_n")) / w, 6).alias("profile"), F.when(F.min(score) < 0, -1).otherwise(1).alias("strict"))


def cutoff(histogram: DataFrame, by: list[str], value: str, n: str, share: float = 0.95) -> DataFrame:
    """The least value up to which the share of all counts lies."""
    w = Window.partitionBy(*by).orderBy(value)
    total = F.sum(n).over(Window.partitionBy(*by))
    run = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return histogram.withColumn("_share", run / total).where(F.col("_share") >= share).groupBy(*by).agg(F.min(value).alias("cutoff"))


def frequencies(cells: DataFrame, by: list[str]) -> DataFrame:
    """Whole percent of each residue."""
    rows = cells.where(~F.col("ch").isin("-", "X", "N", "?"))
    counts = rows.groupBy(*by, "ch").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by))).cast("int"))


def pair_scores(a: str, b: str, kind: str = "nt", matrix: dict[str, float] | None = None) -> np.ndarray:
    """+1 for equal or overlapping states, -1 for different ones, 0 where nothing is known.

    RY: a purine against a pyrimidine differs. matrix: substitution scores by two letters in
    alphabetical order, which replace +1 and -1.
    """
    if kind == "RY":
        table = str.maketrans({**dict.fromkeys(PURINES, "R"), **dict.fromkeys(PYRIMIDINES + "U", "Y")})
        a, b, kind = a.upper().translate(table), b.upper().translate(table), "aa"
    sets = {k: set(v) for k, v in AMBIGUITY.items()}
    out = np.zeros(min(len(a), len(b)))
    for i, (x, y) in enumerate(zip(a.upper(), b.upper(), strict=False)):
        if kind == "nt":
            p, q = sets.get(x), sets.get(y)
            if p is None or q is None or max(len(p), len(q)) >= 4:
                continue
            out[i] = 1 / max(len(p), len(q)) if p & q else -1
        elif x not in "-X?" and y not in "-X?":
            out[i] = (1 if x == y else -1) if matrix is None else matrix.get(min(x, y) + max(x, y), 0.0)
    return out


def score_table(letters: str, kind: str = "nt", matrix: dict[str, float] | None = None) -> np.ndarray:
    """pair_scores of each letter (row) with each other one (column)."""
    n = len(letters)
    return pair_scores("".join(x * n for x in letters), letters * n, kind, matrix).reshape(n, n)


def resampled_scores(df: DataFrame, locus: str, w: int = WINDOW, draws: int = 100, share: float = 0.95, seed: int = 42, kind: str = "nt", legacy: bool = False, matrix: dict[str, float] | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """Site scores of each pair of sequences: a window is +1 if its sum exceeds what the share of resamples of its region reaches.

    A resample is w pairs of residues; each residue is drawn by itself, from either sequence and any
    position of the 2w around the window, which stay inside the sequences (all of them where these
    are shorter). df has (locus, a, b, seq_a, seq_b). Each pair draws from a generator seeded by
    (seed, locus, a, b), so partitioning changes nothing. legacy: a resample is one pair of residues.
    kind aa: nothing is drawn for a window; its sum must exceed the one threshold of its locus.
    thresholds has (locus, threshold) as residue_threshold gives them, from all sequences of the
    locus; where it is left out, they come from the sequences that are in some pair.
    """
    if kind == "aa" and thresholds is None:
        ends = [df.select(locus, F.col(x).alias("taxon"), F.col(f"seq_{x}").alias("seq")) for x in "ab"]
        thresholds = residue_threshold(ends[0].union(ends[1]).distinct(), locus, "seq", w, share=share, seed=seed, matrix=matrix)

    def judged(batches):
        for batch in batches:
            a, b = ([s.upper() for s in batch.column(c).to_pylist()] for c in ("seq_a", "seq_b"))
            limit, parts = np.array(batch.column("threshold")), []
            for at in windows.chunks(a, b):
                n = np.array([min(len(p), len(q)) for p, q in zip(a[at], b[at], strict=True)])
                width = max(int(n.max()), w)
                letters = "".join(sorted(set("".join(a[at]) + "".join(b[at])) | {"-"}))
                letters = letters.replace("-", "") + "-"  # the gap is last: it stands for what is behind the end
                x, y = (windows.places([t[:width].ljust(width, "-") for t in side[at]], letters) for side in (a, b))
                total = windows.window_totals(x, y, score_table(letters, kind, matrix), w)
                parts.append((windows.site_scores(total > limit[at][:, None], n, w), n))
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in (locus, "a", "b")}, "scores": windows.lists(parts, np.zeros(len(a), dtype=bool), pa.int64())})

    def run(batches):
        import zlib

        for rows in batches:
            out = []
            letters = "".join(sorted(set("".join(rows["seq_a"]).upper() + "".join(rows["seq_b"]).upper())))
            table, code = score_table(letters, kind, matrix), {x: i for i, x in enumerate(letters)}
            for key, a, b, sa, sb in zip(rows[locus], rows["a"], rows["b"], rows["seq_a"], rows["seq_b"], strict=True):
                n = min(len(sa), len(sb))
                both = np.array([[code[x] for x in s.upper()[:n]] for s in (sa, sb)], dtype=np.int64)
                s = table[both[0], both[1]]
                draw = np.random.default_rng(zlib.crc32(f"{seed}:{key}:{a}:{b}".encode()))
                site = np.zeros(n, dtype=np.int64)
                for i in range(n - w + 1):
                    total = np.round(s[i : i + w].sum(), 9)
                    if total >= w or total <= -w:
                        passed = total >= w
                    else:
                        start = max(0, min(i - w // 2, n - 2 * w))
                        pool = both[:, start : start + 2 * w].ravel()
                        drawn = pool[draw.integers(0, len(pool), (draws, 1 if legacy else w, 2))]
                        sums = np.sort(np.round(table[drawn[..., 0], drawn[..., 1]].sum(axis=1), 9))
                        passed = total > sums[int(np.ceil(share * draws)) - 1]
                    site[i : i + w] += 1 if passed else -1
                out.append(site.tolist())
            yield rows.assign(scores=out)[[locus, "a", "b", "scores"]]

    kind_of = lambda c: df.schema[c].dataType.simpleString()
    rows, schema = df.select(locus, "a", "b", "seq_a", "seq_b"), f"{locus} {kind_of(locus)}, a {kind_of('a')}, b {kind_of('b')}, scores array<bigint>"
    ship(df.sparkSession)
    if kind != "aa":
        return rows.mapInPandas(run, schema)
    limits = thresholds.select(F.col(locus).alias("_locus"), "threshold")
    rows = rows.join(limits, F.col(locus).eqNullSafe(F.col("_locus")), "left").drop("_locus")
    # Without a residue in the locus no window passes.
    return rows.withColumn("threshold", F.coalesce(F.col("threshold").cast("double"), F.lit(float("nan")))).mapInArrow(judged, schema)


def residue_threshold(df: DataFrame, locus: str, seqs: str, w: int = WINDOW, draws: int = 100, rounds: int = 100, share: float = 0.95, seed: int = 42, matrix: dict[str, float] | None = None, halves: int = 100) -> DataFrame:
    """For each locus the window sum that the share of random pairs of amino acids, drawn by their frequencies, stays under.

    The pool holds ten of a residue for each whole percent. Each of the rounds draws a pool of the
    same size from it, each of the halves of a round draws half as many residues from that one, and
    each of the draws of a half adds the scores of w pairs from there: rounds * halves * draws sums.
    df has each sequence of a locus once. matrix: as for pair_scores. No amino acid: no threshold.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        import zlib

        key = rows[locus].iloc[0]
        joined = "".join(s.upper() for s in rows[seqs] if s is not None)
        counts = np.array([joined.count(c) for c in AMINO_ACIDS])
        value = None
        if counts.sum():
            table = score_table(AMINO_ACIDS, "aa", matrix)
            pool = np.repeat(np.arange(len(AMINO_ACIDS)), 100 * counts // counts.sum() * 10)
            draw, n, sums = np.random.default_rng(zlib.crc32(f"{seed}:{key}".encode())), len(pool), []
            for _ in range(rounds):
                boot = pool[draw.integers(0, n, n)]
                half = boot[draw.integers(0, n, (halves, n // 2))]
                drawn = half[np.arange(halves)[:, None, None, None], draw.integers(0, n // 2, (halves, draws, w, 2))]
                sums.append(np.round(table[drawn[..., 0], drawn[..., 1]].sum(axis=2), 9).ravel())
            at = int(np.ceil(share * rounds * halves * draws)) - 1
            value = float(np.partition(np.concatenate(sums), at)[at])
        return pd.DataFrame({locus: [key], "threshold": [value]})

    ship(df.sparkSession)
    return df.groupBy(locus).applyInPandas(one, f"{locus} {df.schema[locus].dataType.simpleString()}, threshold double")


def consensus(a: Column, b: Column) -> Column:
    """Position by position the letter for what either sequence may have; a gap on either side stays unknown."""
    union = {}
    letters = {frozenset(v): k for k, v in AMBIGUITY.items() if k != "U"}
    for x, p in AMBIGUITY.items():
        for y, q in AMBIGUITY.items():
            union[x + y] = letters[frozenset(p) | frozenset(q)]
    table = F.create_map(*(F.lit(v) for pair in union.items() for v in pair))
    cells = F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.coalesce(F.try_element_at(table, F.concat(x, y)), F.when(x == y, x).otherwise("N")))
    return F.array_join(cells, "")


def redundant_taxa(df: DataFrame, by: list[str], taxon: str, seq: str) -> DataFrame:
    """Taxa whose sequence is another's up to unknowns: the one with fewer residues goes, of equals the one named second."""
    bare = F.translate(F.upper(seq), "-", "")
    rows = df.select(*by, F.col(taxon).alias("t"), bare.alias("s"), F.length(F.regexp_replace(bare, "[NX?]", "")).alias("n"))
    return redundant(rows, by).withColumnRenamed("t", taxon).distinct()


def trimmed(df: DataFrame, by: list[str], taxon: str, seq: str, drop: DataFrame) -> DataFrame:
    """Sequences without the listed positions (from 0); a locus with an empty list stays as it is."""
    cuts = drop.groupBy(*by).agg(F.collect_set("pos").alias("_cut"))
    rows = df.join(cuts, by, "left")
    kept = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when(~F.array_contains("_cut", i), c)), lambda c: c.isNotNull())
    return rows.select(*by, taxon, F.when(F.col("_cut").isNull(), F.col(seq)).otherwise(F.array_join(kept, "")).alias(seq))


def supermatrix(df: DataFrame, locus: str, taxon: str, seq: str, gap: str = "-") -> tuple[DataFrame, DataFrame]:
    """(taxon, sequence) of all loci one after another with gaps for missing ones, and (locus, start, end) from 1.

    Only the loci that a taxon has travel; gaps are filled in between them. Of several sequences of
    one taxon and locus the least is taken.
    """
    lengths = df.groupBy(locus).agg(F.max(F.length(seq)).alias("length"))
    w = Window.orderBy(locus)  # one row for each locus, which are as many as genes
    spans = lengths.select(locus, "length", F.sum("length").over(w).alias("end")).withColumn("start", F.col("end") - F.col("length") + 1)
    total = spans.agg(F.max("end").alias("_total"))
    own = df.groupBy(locus, taxon).agg(F.min(seq).alias("_seq")).join(spans, locus)
    part = F.rpad(F.coalesce("_seq", F.lit("")), F.col("length"), F.lit(gap))
    rows = own.groupBy(taxon).agg(F.sort_array(F.collect_list(F.struct("start", "end", part.alias("p")))).alias("_parts"))
    ends = F.transform("_parts", lambda x, i: F.concat(F.repeat(F.lit(gap), (x["start"] - 1 - F.coalesce(F.get("_parts", i - 1)["end"], F.lit(0))).cast("int")), x["p"]))
    whole = rows.join(F.broadcast(total)).select(taxon, F.rpad(F.array_join(ends, ""), F.col("_total").cast("int"), F.lit(gap)).alias("sequence"))  # total is one row
    return whole, spans.select(locus, "start", "end")


def codon_positions(positions: DataFrame, pos: str, third_only: bool = False) -> DataFrame:
    """Nucleotide positions behind protein positions, from 1."""
    first = 3 * F.col(pos) - 2
    which = F.array(first + 2) if third_only else F.array(first, first + 1, first + 2)
    return positions.select("*", F.explode(which).alias("nucleotide"))


def trim_summary(df: DataFrame, locus: str, original: str, kept: str) -> DataFrame:
    """Original_Length, Trimmed_Length, Removed_Positions and Percent_Removed of each locus."""
    removed = F.length(original) - F.length(kept)
    return df.select(F.col(locus).alias("locus"), F.length(original).alias("original_length"), F.length(kept).alias("trimmed_length"), removed.alias("removed_positions"), F.round(F.coalesce(F.try_divide(100.0 * removed, F.length(original)), F.lit(0.0)), 2).alias("percent_removed"))


def trim_totals(summary: DataFrame) -> DataFrame:
    """Totals, the weighted percentage, and the plain mean over loci."""
    return summary.agg(
        F.count("*").alias("loci"),
        F.sum("original_length").alias("original"),
        F.sum("trimmed_length").alias("trimmed"),
        F.round(F.try_divide(100.0 * F.sum("removed_positions"), F.sum("original_length")), 2).alias("percent_weighted"),
        F.round(F.avg("percent_removed"), 2).alias("percent_mean"),
        F.round(F.avg("trimmed_length"), 2).alias("mean_trimmed_length"),
    )


def short_loci(df: DataFrame, by: str, seq: str, least: int) -> DataFrame:
    """Of each group how many sequences are shorter than least, and their mean length."""
    return df.groupBy(by).agg(F.count_if(F.length(seq) < least).alias("short_loci"), F.round(F.avg(F.length(seq)), 2).alias("mean_length"))


def assemblies(df: DataFrame, level: str, levels: list[str] | None, n50: str, least_n50: float | None, annotated: str | None = None, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Assemblies of the wanted levels with enough contiguity (unknown fails) and annotation."""
    out = df
    if levels:
        out = out.where(F.col(level).isin(*levels))
    if least_n50 is not None:
        out = out.where(F.coalesce(F.col(n50) >= least_n50, F.lit(False)))
    if annotated:
        out = out.where(F.col(annotated).isNotNull())
    return out.orderBy(*(order or [])).limit(most) if most else out


def completeness(s: Column, d: Column, f: Column, m: Column) -> Column:
    """Percent of markers found complete, two decimals."""
    return F.round(F.coalesce(F.try_divide(100.0 * (s + d), s + d + f + m), F.lit(0.0)), 2)
