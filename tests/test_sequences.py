"""Monte-Carlo scores of sequences against slow direct versions with the same seeds."""

import inspect
import math
import random
import zlib

import numpy as np
import pytest

from tessella.functions.shipping import ship
from tessella.operators import models, sequences

PAIR = "locus string, a string, b string, seq_a string, seq_b string"


def slow_scores(key, a, b, sa, sb, kind, w, seed=42):
    draw = np.random.default_rng(zlib.crc32(f"{seed}:{key}:{a}:{b}".encode()))
    score = lambda x, y: sequences.pair_scores(x, y, kind)[0]
    n = len(sa)
    site = [0] * n
    for j in range(n - w + 1):
        own = sum(score(sa[j + k], sb[j + k]) for k in range(w))
        if round(own, 9) in (w, -w):
            sign = 1 if own > 0 else -1
        else:
            if j < w / 2:
                region = range(2 * w)
            elif j > n - (w + w / 2):
                region = range(n - 2 * w, n)
            else:
                region = range(j - w // 2, j - w // 2 + 2 * w)
            residues = [s[p] for s in (sa, sb) for p in region]
            sums = sorted(round(sum(score(residues[x], residues[y]) for x, y in one), 9) for one in draw.integers(0, 4 * w, (100, w, 2)))
            sign = 1 if round(own, 9) > sums[94] else -1
        for k in range(w):
            site[j + k] += sign
    return site


@pytest.mark.parametrize(("kind", "w"), [("nt", 6), ("nt", 4), ("RY", 6)])
def test_windows_against_pairs_of_residues(spark, kind, w):
    r = random.Random(w)
    rows = []
    for i in range(4):
        sa = "".join(r.choice("ACGT" if i else "ACGTRYN-") for _ in range(30))
        rows.append(("L", f"x{i}", f"y{i}", sa, "".join(c if r.random() < 0.65 else r.choice("ACGT") for c in sa)))
    # Four of six columns agree in each window of six: random pairs of these residues seldom do.
    sa = "ACGTTGCAGTCATACG" * 2
    rows.append(("L", "p", "q", sa, "".join("CGTA"["ACGT".index(c)] if i % 3 == 2 else c for i, c in enumerate(sa))))
    ship(spark)
    got = {x.a: x.scores for x in sequences.resampled_scores(spark.createDataFrame(rows, PAIR), "locus", w=w, kind=kind).collect()}
    assert got == {x[1]: slow_scores(*x, kind, w) for x in rows}
    assert (kind, w) != ("nt", 6) or sum(got["p"]) > 0


def slow_threshold(key, seqs, w, matrix, rounds, halves, draws, seed=42):
    draw = np.random.default_rng(zlib.crc32(f"{seed}:{key}".encode()))
    known = [c for s in seqs for c in s if c in "ARNDCQEGHILKMFPSTWYV"]
    pool = [c for c in "ARNDCQEGHILKMFPSTWYV" for _ in range(100 * known.count(c) // len(known) * 10)]
    sums = []
    for _ in range(rounds):
        boot = [pool[x] for x in draw.integers(0, len(pool), len(pool))]
        picks = draw.integers(0, len(pool), (halves, len(pool) // 2))
        for half, sets in zip(picks, draw.integers(0, len(pool) // 2, (halves, draws, w, 2)), strict=True):
            sums += [sum(sequences.pair_scores(boot[half[x]], boot[half[y]], "aa", matrix)[0] for x, y in one) for one in sets]
    return sorted(sums)[int(np.ceil(0.95 * len(sums))) - 1]


MATRIX = {x + y: 4.0 if x == y else (1.0 if x + y in ("IL", "IV", "LV", "KR", "DE") else -2.0) for x in "ACDEFGHIKLMNPQRSTVWY" for y in "ACDEFGHIKLMNPQRSTVWY" if x <= y}
PROTEINS = ["MKVLAMKV-WLLDERKX", "MKILAMRVBWLLEERK*", "AKVIGMKVSWVLDDRKT"]


@pytest.mark.parametrize("matrix", [None, MATRIX])
def test_threshold_of_a_locus(spark, matrix):
    df = spark.createDataFrame([("L", s) for s in PROTEINS] + [("none", "-X?")], "locus string, seq string")
    ship(spark)
    got = {x.locus: x.threshold for x in sequences.residue_threshold(df, "locus", "seq", draws=5, rounds=3, halves=4, matrix=matrix).collect()}
    assert got == {"L": slow_threshold("L", PROTEINS, 6, matrix, 3, 4, 5), "none": None}


def test_a_million_sums():
    levels = inspect.signature(sequences.residue_threshold).parameters
    assert levels["rounds"].default * levels["halves"].default * levels["draws"].default == 1_000_000


def test_amino_acids_by_one_threshold(spark):
    rows = [("L", a, b, PROTEINS[a], PROTEINS[b]) for a in range(3) for b in range(a + 1, 3)]
    pairs = spark.createDataFrame(rows, "locus string, a int, b int, seq_a string, seq_b string")
    seqs = spark.createDataFrame([("L", i, s) for i, s in enumerate(PROTEINS)], "locus string, taxon int, seq string")
    ship(spark)
    limits = sequences.residue_threshold(seqs, "locus", "seq", matrix=MATRIX)
    limit = limits.first().threshold
    expected = {}
    for _, a, b, sa, sb in rows:
        s = sequences.pair_scores(sa, sb, "aa", MATRIX)
        expected[a, b] = [0] * len(s)
        for i in range(len(s) - 5):
            for k in range(6):
                expected[a, b][i + k] += 1 if s[i : i + 6].sum() > limit else -1
    for given in (limits, None):
        got = sequences.resampled_scores(pairs, "locus", kind="aa", matrix=MATRIX, thresholds=given)
        assert {(x.a, x.b): x.scores for x in got.collect()} == expected
    other = limits.selectExpr("locus", "1000D AS threshold")
    assert all(v < 0 for x in sequences.resampled_scores(pairs, "locus", kind="aa", thresholds=other).collect() for v in x.scores)


def path_lengths(newick):
    """Distances between the leaves of a tree with branch lengths, walked by hand."""
    text, at = newick.rstrip(";"), 0
    pairs = {}

    def node():
        nonlocal at
        if text[at] != "(":
            end = next(i for i in range(at, len(text) + 1) if i == len(text) or text[i] in ",():")
            name, at = text[at:end], end
            return {name: 0.0}
        children = []
        while text[at] in "(,":
            at += 1
            own, length = node(), 0.0
            if at < len(text) and text[at] == ":":
                end = next(i for i in range(at + 1, len(text) + 1) if i == len(text) or text[i] in ",()")
                length, at = float(text[at + 1 : end]), end
            children.append({k: v + length for k, v in own.items()})
        at += 1
        for i, a in enumerate(children):
            for b in children[i + 1 :]:
                pairs.update({frozenset((x, y)): dx + dy for x, dx in a.items() for y, dy in b.items()})
        return {k: v for c in children for k, v in c.items()}

    node()
    return pairs


@pytest.mark.parametrize("seed", range(4))
def test_trees_give_additive_distances_back(spark, seed):
    r = random.Random(seed)
    trees = [f"t{i}" for i in range(7)]
    while len(trees) > 2:
        a, b = r.sample(trees, 2)
        trees = [t for t in trees if t not in (a, b)] + [f"({a}:{r.randint(1, 9)},{b}:{r.randint(1, 9)})"]
    given = path_lengths(f"({trees[0]}:3,{trees[1]}:4);")
    rows = [(1, *sorted(pair), float(d)) for pair, d in given.items()]
    made = sequences.trees(spark.createDataFrame(rows, "locus long, a string, b string, distance double"), "locus").first().newick
    back = path_lengths(made)
    assert back.keys() == given.keys() and all(abs(back[k] - given[k]) < 1e-4 for k in given)


def test_tail_of_the_ratio_tests(spark):
    rows = [(i, m, -100.0 + i * 0.7 * (m != "A")) for i in range(12) for m in ("A", "A+J")]
    made = models.ratio_tests(spark.createDataFrame(rows, "by long, model string, lnl double"), ["by"]).collect()
    assert len(made) == 12
    for x in made:
        assert abs(x.statistic - 1.4 * x.by) < 1e-9 and abs(x.p - math.erfc(math.sqrt(x.statistic / 2))) < 1e-12 and x.significant == (x.p < 0.05)
