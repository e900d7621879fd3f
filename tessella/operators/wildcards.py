"""Sequences that agree up to unknown letters, without comparing all pairs.

Sequences with at most `FEW` unknown letters meet by seeds: sets of columns such that, wherever the unknown letters of two
of them are, one set at least is known in both. A sequence travels once for each set that is known in it, with more columns in
a set where more sequences are to be told apart. Those of one seed come best first, and each is compared with the
first `4 * most` until one says more than it; what those don't settle, and all pairs of which one has more unknown letters, goes down a tree.

Distinct sequences of a group go down the tree: a group with more than `most` of them is split by the
column that separates best, known letters into one branch each, unknown ones into all branches. Two
sequences that agree stay together in one branch at least. A group without unknown letters holds no
two that agree and ends at once. What is left is compared in groups of `most` (or of what no column separates).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.shipping import ship
from tessella.sources.scratch import stored

UNKNOWN = "NX?"
MOST = 64
#: A column separates if its largest branch has at most this share of a group.
SHARE = 0.8
DEEPEST = 100
#: Unknown letters of a sequence that goes by seeds, and blocks of columns of which seeds are made.
FEW = 2
BLOCKS = 12
#: Sequences of a locus for each value of a seed, if letters were equally frequent: more of them, fewer copies travel.
TOGETHER = 128


def is_unknown(letter: Column) -> Column:
    return letter.isin(*UNKNOWN)


def separating(cells: DataFrame, key: list[str]) -> DataFrame:
    """For each group the column whose largest branch is smallest, with its letters."""
    counts = cells.groupBy(*key, "pos", "ch").agg(F.count("*").alias("n"))
    known = ~is_unknown(F.col("ch"))
    by_column = counts.groupBy(*key, "pos").agg(
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("u"),
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("most"),
        F.sum("n").alias("all"),
        F.collect_set(F.when(known, F.col("ch"))).alias("letters"),  # an alphabet
    )
    largest = F.col("most") + F.col("u")
    copies = F.col("all") + F.col("u") * F.size("letters")
    best = by_column.where((largest <= SHARE * F.col("all")) & (F.size("letters") > 1)).groupBy(*key).agg(F.min_by(F.struct("pos", "letters"), F.struct(largest, copies, "pos")).alias("best"))
    return best.select(*key, "best.pos", "best.letters")


def unknowns(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, UNKNOWN, ""))


def agreeing_groups(classes: DataFrame, by: list[str], most: int = MOST, fewest: int = 1) -> DataFrame:
    """classes (by, s and more columns) in groups (size, path) that hold all agreeing pairs of which one has `fewest` unknown letters; a class can be in several groups."""
    key = [*by, "size", "path"]
    rest = classes.withColumn("size", F.length("s")).withColumn("path", F.lit(""))
    closed = []
    for level in range(DEEPEST):
        groups = rest.groupBy(*key).agg(F.count("*").alias("_n"), F.count_if(unknowns(F.col("s")) >= fewest).alias("_w")).where("_n > 1 AND _w > 0")
        rest = stored(rest.join(groups, key).drop("_w"), f"groups-{level}")
        closed.append(rest.where(F.col("_n") <= most).drop("_n"))
        rest = rest.where(F.col("_n") > most).drop("_n")
        if not rest.head(1):
            break
        cells = rest.select(*key, F.posexplode(F.split("s", "")).alias("pos", "ch")).where("ch <> ''")
        split = stored(separating(cells, key), f"columns-{level}")
        closed.append(rest.join(split.select(*key), key, "left_anti"))
        letter = F.substr("s", F.col("pos") + 1, F.lit(1))
        branch = F.explode(F.when(is_unknown(letter), F.col("letters")).otherwise(F.array(letter)))
        rest = rest.join(split, key).withColumn("_b", branch).withColumn("path", F.concat("path", "_b")).drop("pos", "letters", "_b")
    else:
        closed.append(rest)
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out


def agree(a: Column, b: Column) -> Column:
    """Whether two sequences of one length have equal letters wherever both are known."""
    return F.forall(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) | is_unknown(x) | is_unknown(y)), lambda v: v)


@lru_cache(maxsize=4096)
def seed_columns(size: int, told: int) -> tuple[tuple[int, ...], ...]:
    """Sets of columns (`told` of them or more, as far as there are) of which any 2 * FEW unknown columns leave one alone."""
    off = 2 * FEW
    if not told or size <= off:
        return ((),)
    if size // (off + 1) >= told:
        return tuple(tuple(range(i, size, off + 1)) for i in range(off + 1))
    m = min(size, BLOCKS)
    r = next((r for r in range(1, m - off) if r * size // m >= told), m - off)
    return tuple(tuple(c for b in blocks for c in range(b, size, m)) for blocks in covering(m, r, off))


@lru_cache(maxsize=64)
def covering(m: int, r: int, off: int) -> list[tuple[int, ...]]:
    """Sets of r of m numbers, chosen so that any `off` numbers are outside one of them."""
    sets, holes = list(combinations(range(m), r)), list(combinations(range(m), off))
    inside = lambda rows: np.array([[c in row for c in range(m)] for row in rows], int)
    free = inside(sets) @ inside(holes).T == 0
    open_, chosen = np.ones(len(holes), bool), []
    while open_.any():
        best = int((free & open_).sum(1).argmax())
        chosen.append(sets[best])
        open_ &= ~free[best]
    return chosen


def letters_of(s: pa.Array) -> np.ndarray:
    """A row of code points for each sequence, 0 for unknown ones and beyond its end."""
    texts = np.array(s.to_pylist(), dtype=str)
    if not texts.dtype.itemsize:
        return np.zeros((len(texts), 0), np.uint32)
    made = np.ascontiguousarray(texts).view(np.uint32).reshape(len(texts), -1)
    return np.where(np.isin(made, [ord(c) for c in UNKNOWN]), 0, made)


def mixed(h: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    h = (h ^ np.asarray(x).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (locus, size, told, s, ...) once for each of their seeds; two of a locus with one seed may differ there, as it is a hash."""
    for b in batches:
        locus, size, told = (b.column(c).to_numpy(zero_copy_only=False) for c in ("locus", "size", "told"))
        letters, rows, seeds = letters_of(b.column("s")), [], []
        for n, k in sorted(set(zip(size.tolist(), told.tolist(), strict=True))):
            own = np.flatnonzero((size == n) & (told == k))
            x = letters[own, :n]
            few = (x == 0).sum(1) <= FEW
            for j, columns in enumerate(seed_columns(n, k)):
                at = np.flatnonzero(few & (x[:, list(columns)] != 0).all(1))
                h = mixed(mixed(locus[own[at]].astype(np.uint64), -1), j)
                for c in columns:
                    h = mixed(h, x[at, c])
                rows.append(own[at])
                seeds.append(h.view(np.int64))
        if rows:
            at = pa.array(np.concatenate(rows))
            made = {c: b.column(c).take(at) for c in ("locus", "s", "n", "first", "single")}
            yield pa.RecordBatch.from_pydict(made | {"seed": pa.array(np.concatenate(seeds))})


def judging(most: int):
    """A function of rows sorted by seed, locus and best first: which are beaten by one of the first `most` with their seed, and which seeds that leaves open."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first rows of the last seed
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            kept = 0 if held is None else held.num_rows
            seed, locus, n, single = (t.column(c).to_numpy() for c in ("seed", "locus", "n", "single"))
            letters, first = letters_of(t.column("s")), t.column("first").combine_chunks()
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (locus[1:] != locus[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(seed)), 0))
            left, beaten = np.arange(kept, len(seed)), []
            for k in range(most):
                left = left[start[left] + k < left]
                if not len(left):
                    break
                head = start[left] + k
                x, y = letters[left], letters[head]
                won = np.flatnonzero(((x == y) | (x == 0) | (y == 0)).all(1))
                # Of one name only, and the same: no other one says as much.
                same = pc.equal(first.take(pa.array(left[won])), first.take(pa.array(head[won]))).to_numpy(zero_copy_only=False)
                won = won[~(same & (single[head[won]] | (n[head[won]] == n[left[won]])))]
                beaten.append(left[won])
                left = np.delete(left, won)
            left = left[start[left] + most < left]
            gone = np.concatenate([*beaten, left[:0]])
            still = np.unique(left[np.r_[True, seed[left][1:] != seed[left][:-1]]] if len(left) else left)
            names, at = first.take(pa.array(gone)), pa.array(np.concatenate([seed[gone], seed[still]]), mask=np.arange(len(gone) + len(still)) < len(gone))
            yield pa.RecordBatch.from_pydict({"locus": pa.array(np.concatenate([locus[gone], locus[still]])), "first": pa.concat_arrays([names, pa.nulls(len(still), names.type)]), "seed": at})
            held = t.slice(start[-1], min(most, len(seed) - start[-1]))

    return judged


def beaten_in(groups: DataFrame, key: list[str]) -> DataFrame:
    """Of rows in groups, the first names of those that another one of their group beats."""
    a, b = groups.alias("a"), groups.alias("b")
    better = (F.col("a.n") > F.col("b.n")) & ((F.col("a.first") != F.col("b.first")) | ~F.col("a.single")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.first") < F.col("b.first"))
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in key] + [F.col("a.s") != F.col("b.s"), better])
    return met.where(agree(F.col("a.s"), F.col("b.s"))).select("b.locus", "b.first")


def redundant(rows: DataFrame, by: list[str], most: int = MOST) -> DataFrame:
    """Of rows (by, t, s, n), those whose sequence s agrees with another's that has a larger n, or the same n and a smaller t; some come twice."""
    spark = rows.sparkSession
    rows = stored(rows.dropna(subset=[*by, "t"]), "rows")
    classes = stored(rows.groupBy(*by, "s").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("n").alias("n")).withColumn("size", F.length("s")), "classes")
    # One letter of each sequence tells how many there are.
    letter = F.substr("s", 1 + F.pmod(F.xxhash64("s"), F.greatest("size", F.lit(1))).cast("int"), F.lit(1))
    u = unknowns(F.col("s"))
    loci = classes.groupBy(*by, "size").agg(F.count("*").alias("_n"), F.approx_count_distinct(letter).alias("_letters"), F.count_if(u > 0).alias("_u"), F.count_if(u > FEW).alias("_wide"))
    told = F.when(F.col("_n") <= most, 0).otherwise(F.ceil(F.log(F.greatest(F.col("_n") / TOGETHER, F.lit(1.0))) / F.log(F.greatest("_letters", F.lit(2)).cast("double")))).cast("int")
    loci = stored(loci.where("_n > 1 AND _u > 0").select(*by, "size", F.monotonically_increasing_id().alias("locus"), told.alias("told"), "_wide"), "loci")
    own = classes.join(loci, [*by, "size"]).select("locus", "size", "told", "s", F.col("n").cast("long").alias("n"), "first", (F.col("first") == F.col("last")).alias("single"), "_wide")
    name = own.schema["first"].dataType.simpleString()
    ship(spark)
    seeds = own.drop("_wide").mapInArrow(seeded, f"locus long, s string, n long, first {name}, single boolean, seed long")
    best_first = seeds.repartition("seed").sortWithinPartitions("seed", "locus", F.desc("n"), "first")
    judged = stored(best_first.mapInArrow(judging(4 * most), f"locus long, first {name}, seed long").distinct(), "judged")
    beaten = judged.where("seed IS NULL").select("locus", "first")
    still = judged.where("seed IS NOT NULL").select("locus", "seed")
    if still.head(1):
        groups = agreeing_groups(stored(seeds.join(still, ["locus", "seed"]), "still"), ["locus", "seed"], most)
        beaten = beaten.unionByName(beaten_in(stored(groups, "agreeing"), ["locus", "seed", "size", "path"]))
    if loci.where("_wide > 0").head(1):
        groups = agreeing_groups(own.where("_wide > 0").drop("_wide", "told", "size"), ["locus"], most, FEW + 1)
        beaten = beaten.unionByName(beaten_in(stored(groups, "wide"), ["locus", "size", "path"]))
    copies = rows.join(classes.where("last > first").select(*by, "s", "first"), [*by, "s"]).where("t > first").select(*by, "t")
    return copies.unionByName(beaten.join(loci, "locus").select(*by, F.col("first").alias("t")))
