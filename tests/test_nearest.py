import math
import random

import pytest

from tessella.operators import nearest, places


def brute(a, b, k, tolerance, ties):
    out = set()
    for i, x, y in a:
        if x is None or math.isnan(x):
            continue
        found = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in b if u is not None and not math.isnan(u) and math.sqrt((x - u) ** 2 + (y - v) ** 2) <= tolerance)
        last = found[k - 1][0] if len(found) >= k else math.inf
        out |= {(i, j) for d, j in found if d <= last} if ties else {(i, j) for _, j in found[:k]}
    return out


def some_points(r, n):
    """Scattered ones, dense ones, many at one place, and some without."""
    out = [(r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(n // 4)] + [(1 + r.gauss(0, 0.002), 1 + r.gauss(0, 0.002)) for _ in range(n // 2)] + [(0.5, 0.5)] * (n // 4) + [(0.0, -0.0), (-0.0, 0.0), (None, 1.0), (float("nan"), 1.0)]
    return [(i, x, y) for i, (x, y) in enumerate(out)]


@pytest.mark.parametrize(("k", "tie"), [(1, True), (4, True), (3, False)])
def test_equals_all_pairs(spark, k, tie):
    r = random.Random(k)
    a, b = some_points(r, 160), some_points(r, 240)
    got = nearest.nearest(spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, x double, y double"), "x", "y", k, 0.6, tie=["j"] if tie else None, most=4)
    rows = [(x.l.i, x.r.j) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(a, b, k, 0.6, not tie)


def test_no_rows(spark):
    none = spark.createDataFrame([], "i int, x double, y double")
    some = spark.createDataFrame([(1, 0.0, 0.0)], "i int, x double, y double")
    assert nearest.nearest(none, some, "x", "y", 2, 1.0).count() == 0 == nearest.nearest(some, none, "x", "y", 2, 1.0).count()


def test_a_dense_place_makes_pairs_in_proportion(spark, monkeypatch):
    pairs = []

    def counted(front, k, tolerance, old=nearest.reachable):
        out = old(front, k, tolerance)
        pairs.append(out.where("leaf").agg({"rows": "sum"}).first()[0] or 0)
        return out

    monkeypatch.setattr(nearest, "reachable", counted)
    r = random.Random(9)
    for n in (1000, 4000):
        pairs.clear()
        dense = [(i, 1 + r.uniform(0, 0.001), 1 + r.uniform(0, 0.001)) for i in range(n)]
        df = spark.createDataFrame(dense, "i int, x double, y double")
        got = nearest.nearest(df, df, "x", "y", 3, 0.5, tie=["i"], most=16)
        assert got.count() == 3 * n
        assert pairs[-1] < 150 * n  # of n * n that lie within the tolerance


def test_records_of_one_place_and_name_are_scored_once(spark):
    fields = ", ".join(f"{f} string" for f in places.LEVELS)
    rows = [(i, *["Asia", "Peru", None, None, None, "L"], 1.0, 1.0) for i in range(3000)]
    sites = spark.createDataFrame(rows, f"site int, {fields}, lat double, lon double")
    records = spark.createDataFrame(rows, f"irn int, {fields}, lat double, lon double")
    got = places.match_by_coordinates(sites, records, "site", "irn", "lat", "lon", k=2, similarity=lambda a, b: (a == b).cast("double")).collect()
    assert len(got) == 6000 and {x.irn for x in got} == {0, 1} and {(x.rank, x.irn) for x in got} == {(1, 0), (2, 1)}
