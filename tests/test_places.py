import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import similarity
from tessella.functions.similarity import by_levenshtein
from tessella.operators import nodes, places

SITE = "site_index int, continent string, country string, province string, district string, township string, locality string, lat double, lon double"
RECORD = SITE.replace("site_index int", "irn string") + ", site_number string"


def test_near_equals_all_pairs(spark):
    r = random.Random(7)
    points = lambda n: [(i, r.uniform(-0.05, 0.05), r.uniform(-0.05, 0.05)) for i in range(n)] + [(n, None, 1.0)]
    a, b = points(150), points(150)
    got = places.near(spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, x double, y double"), "x", "y", 0.005)
    want = {(p[0], q[0]) for p in a for q in b if None not in (p[1], q[1]) and math.hypot(p[1] - q[1], p[2] - q[2]) <= 0.005}
    assert {(x.l.i, x.r.j) for x in got.collect()} == want


def test_deduplicate_keeps_the_first(spark):
    rows = [(4, " a ", None), (5, "a", ""), (6, "b", "x"), (7, None, " "), (8, "a", None)]
    made = places.deduplicate(spark.createDataFrame(rows, "row int, f string, g string"), ["f", "g"], "row").collect()
    assert sorted((x.f, tuple(x.original_rows), x.specimen_count) for x in made) == [(" a ", (4, 5, 8), 3), ("b", (6,), 1)]


def test_scores_and_classes(spark):
    lit = lambda x: F.lit(x).cast("string")
    own = dict(zip(places.LEVELS, map(lit, ("Asia", "Peru", "P", None, None, "L")), strict=True))
    rec = dict(zip(places.LEVELS, map(lit, ("Asia", "Peru", None, None, "T", "L")), strict=True))
    score = spark.range(1).select(places.match_score(own, rec, by_levenshtein).alias("s")).first().s
    assert score == round((5 + 10 + 1.5 + 2.5 + 25) / 80 * 100, 1)
    cases = [(90.0, 99.0, 0.1, "exact"), (90.0, 200.0, 0.96, "exact"), (90.0, 200.0, 0.95, "near"), (60.0, 1.0, 1.0, "near"), (59.9, 1.0, 1.0, "none")]
    for s, m, n, want in cases:
        assert spark.range(1).select(places.match_class(F.lit(s), F.lit(m), F.lit(n)).alias("c")).first().c == want


def site(spark):
    return spark.createDataFrame([(1, "North America", "United States", "Arizona", "Cochise", None, "San Simon", 32.0, -109.0), (2, "Africa", None, None, None, None, None, None, None)], SITE)


def records(spark):
    rows = [
        ("10", "North America", "United States of America", "Arizona", "Chochise", None, None, None, None, ""),
        ("11", "North America", "United States of America", "Arizona", None, None, None, None, None, ""),
        ("12", "North America", "United States of America", "Arizona", "Cochise", None, "San Simon", 32.001, -109.001, "S1"),
        ("13", "Africa", None, None, None, None, None, None, None, ""),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_match_and_parents(spark):
    near = places.match_by_coordinates(site(spark), records(spark), "site_index", "irn", "lat", "lon").collect()
    assert [(x.site_index, x.irn) for x in near] == [(1, "12")] and 150 < near[0].distance_m < 160
    named = places.match_by_name(site(spark).where("site_index = 1"), records(spark), "site_index", "irn", "locality").collect()
    assert [x.irn for x in named] == ["12"]
    found = {x.site_index: (x.status, x.parent, x.search_level) for x in places.find_parents(site(spark), records(spark), "site_index", "irn", "site_number").collect()}
    assert found == {1: ("perfect", "10", 3), 2: ("not_found", None, None)}


def test_named_node(spark):
    names = spark.createDataFrame([("Cochise", "Arizona"), ("Cochise", "Sonora")], "district string, province string")
    got = places.match_node(names, records(spark), "district", ["province"], "irn", "site_number").collect()
    assert [(x.province, x.irn) for x in got] == [("Arizona", "10")]


def test_batches(spark):
    node = "rank string, name string, status string, irn string, coords struct<lat:double,lon:double>, elevation struct<from_m:double>"
    chains = spark.createDataFrame(
        [
            (0, "7", [("District", "Cochise", "exists", "8", None, None), ("Village", "San Simon", "needs_creation", None, None, None), ("Precise Locality", None, "needs_creation", None, (31.9, -109.1), (1380.0,))]),
            (1, "8", [("Village", "San Simon", "needs_creation", None, None, None), ("Precise Locality", "x", "needs_creation", None, None, None)]),
            (2, None, [("Village", "Other", "needs_creation", None, None, None)]),
            (3, "8", [("Village", "San Simon", "needs_creation", None, None, None)]),
        ],
        f"chain int, parent string, nodes array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in node.split(', '))}>>",
    )
    made = nodes.plan_batches(chains, "chain", "parent", "nodes")
    got = sorted((x.id, x.depth, x["rank"], x.name, x.parent_ref) for x in made.collect())
    assert got == [(1, 1, "Village", "San Simon", "8"), (2, 2, "Precise Locality", "", "__PENDING_B1_R1__"), (3, 2, "Precise Locality", "x", "__PENDING_B1_R1__"), (4, 1, "Village", "Other", "")]
    solved = nodes.resolve(made, spark.createDataFrame([(1, 1, "99")], "depth int, id int, irn string"))
    assert {x.parent_ref for x in solved.collect()} == {"8", "99", ""}
    assert nodes.rejected_ranks(made.withColumn("rank", F.lit("Hamlet")), "rank").count() == 4 and nodes.rejected_ranks(made, "rank").count() == 0
    filled = nodes.back_fill(spark.createDataFrame([(4, "a"), (5, "b")], "row int, site_number string"), spark.createDataFrame([(4, "77")], "row int, irn string"), "row", "irn", "site_number")
    assert filled.columns == ["row", "site_number", "irn"] and {x.row: x.irn for x in filled.collect()} == {4: "77", 5: None}


def test_filled_columns(spark):
    df = spark.createDataFrame([(1, "", None, "x"), (2, " ", None, "")], "a int, b string, c string, d string")
    assert nodes.filled_columns(df) == ["a", "d"]


@pytest.mark.parametrize(("native", "threshold"), [(True, 0.75), (True, 0.6), (False, 0.85), (False, 0.5)])
def test_no_similar_pair_is_lost(spark, native, threshold):
    r = random.Random(7)
    names = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 12))) for alphabet in ("ab", "aeinst ", "abcxyzé1") for _ in range(40)} - {""})
    names = sorted({" ".join(n.split()) for n in names} - {""} - set(similarity.ALIASES))
    near = sorted({n[:i] + r.choice("aeé") + n[i + 1 :] for n in names for i in (r.randrange(len(n)),)} | set(names))
    near = [n for n in near if n.strip() == n]
    a, b = (spark.createDataFrame([(n,) for n in x], "name string") for x in (names, near))
    got = {(x.left_name, x.right_name) for x in similarity.similar_names(a, b, threshold, native=native).collect()}

    def ratio(x, y):
        if native:
            row = list(range(len(y) + 1))
            for i, c in enumerate(x):
                row, old = [i + 1], row
                for j, e in enumerate(y):
                    row.append(min(row[-1] + 1, old[j + 1] + 1, old[j] + (c != e)))
            return 1 - row[-1] / max(len(x), len(y))
        return 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()

    assert got == {(x, y) for x in names for y in near if ratio(x, y) >= threshold}


def test_numbers_in_sequence(spark):
    from tessella.operators.numbering import in_sequence

    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id").repartition(7)
    got = {r.k: r.n for r in in_sequence(rows, ["k"], "n", 5).collect()}
    assert got == {k: k + 5 for k in range(1000)}
    assert in_sequence(rows.limit(0), ["k"], "n").count() == 0
