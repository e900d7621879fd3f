import random

import pytest

from tessella.operators import sequences, wildcards


def brute(rows):
    bare = [(g, t, s.upper().replace("-", "")) for g, t, s in rows]
    known = lambda s: sum(c not in "NX?" for c in s)
    out = set()
    for i, (g, t, s) in enumerate(bare):
        for h, u, v in bare[i + 1 :]:
            if g == h and t != u and len(s) == len(v) and all(x == y or x in "NX?" or y in "NX?" for x, y in zip(s, v, strict=True)):
                (a, x), (b, y) = sorted([(t, s), (u, v)])
                out.add((g, a if known(x) < known(y) else b))
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, 64), (2, 3), (3, 1)])
def test_redundant_taxa_equal_brute_force(spark, seed, most, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(wildcards.redundant, "__defaults__", (most,))
    bases = ["".join(r.choice("ACGT") for _ in range(r.choice([8, 8, 9]))) for _ in range(12)] + ["A" * 8, ""]
    rows = []
    for i in range(220):
        s = "".join("N?X"[r.randrange(3)] if r.random() < 0.12 else (r.choice("ACGT") if r.random() < 0.02 else c) for c in r.choice(bases))
        rows.append((f"l{i % 2}", f"t{r.randrange(10**6)}", s[:3] + "-" + s[3:].lower()))
    rows += [("l0", "all", "NNNNNNNN"), ("l0", "all2", "NNNNNNNN"), ("l1", "gap", "--------"), ("l1", "none", "")]
    got = sequences.redundant_taxa(spark.createDataFrame(rows, "g string, t string, s string"), ["g"], "t", "s")
    made = [tuple(x) for x in got.collect()]
    assert len(made) == len(set(made)) and set(made) == brute(rows)


def test_pairs_in_proportion(spark):
    r = random.Random(5)
    made = []
    for n in (2500, 10_000):
        rows = [("g", "".join("N" if r.random() < 0.05 else r.choice("ACGT") for _ in range(40)), i, 40) for i in range(n)]
        groups = wildcards.agreeing_groups(spark.createDataFrame(rows, "g string, s string, first int, n int"), ["g"])
        sizes = [x["count"] for x in groups.groupBy("g", "size", "path").count().collect()]
        made.append(sum(k * (k - 1) // 2 for k in sizes))
        assert max(sizes) <= wildcards.MOST
    assert made[1] < 8 * made[0] and made[1] < 10_000 * 10_000 / 100


def test_known_sequences_make_no_pairs(spark):
    rows = spark.range(3000).selectExpr("'g' AS g", "string(id) AS s", "id AS first", "id AS n")
    assert wildcards.agreeing_groups(rows, ["g"]).count() == 0


def test_few_unknown_letters_need_no_tree(spark, monkeypatch):
    r = random.Random(7)
    bases = ["".join(r.choice("0123456789abcdef") for _ in range(12)) for _ in range(300)]
    rows = [("g", i, "".join("?" if k in (i % 13, i % 7 + 3) else c for k, c in enumerate(r.choice(bases)))) for i in range(1500)]
    monkeypatch.setattr(wildcards, "agreeing_groups", None)
    got = sequences.redundant_taxa(spark.createDataFrame(rows, "g string, t long, s string"), ["g"], "t", "s")
    assert {tuple(x) for x in got.collect()} == brute(rows)


@pytest.mark.parametrize(("size", "told"), [(3, 2), (5, 1), (7, 3), (12, 4), (12, 8), (31, 2), (31, 9), (40, 8)])
def test_two_sequences_share_a_seed_that_is_known_in_both(size, told):
    sets = [set(x) for x in wildcards.seed_columns(size, told)]
    r = random.Random(size)
    for _ in range(2000):
        hidden = set(r.sample(range(size), min(size, 2 * wildcards.FEW)))
        assert any(not s & hidden for s in sets)
