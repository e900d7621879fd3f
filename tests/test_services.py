from pyspark.sql import functions as F

from tessella.operators import services


def test_one_table_function_asks_each_key_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def say(value, parameters):
        n = len([x for x in seen.iterdir() if x.name.startswith(f"{value}{parameters.get('p', '')}-")])
        (seen / f"{value}{parameters.get('p', '')}-{n}").touch()
        if value == "down" or (value == "slow" and n < 2):
            raise OSError("busy")
        return None if value == "unknown" else {"n": value + parameters.get("p", ""), "extra": "left out"}

    rows = [(1, "a", "b", [("a", 1), (None, 2), ("slow", 3)], "t"), (2, "a", " ", None, "t"), (3, None, "None", [], "t"), (4, "down", "unknown", [("b", 1)], "t"), (1, "a", "b", [("a", 1), (None, 2), ("slow", 3)], "t")]
    df = spark.createDataFrame(rows, "id int, x string, y string, r array<struct<k:string,v:int>>, told string")
    config = [{"field": "x", "api": "s", "output_field": "told"}, {"field": "y", "api": "s", "output_field": "b"}, {"field": "r.k", "api": "s", "output_field": "c"}, {"field": "x", "api": "s", "output_field": "d", "extra_params": {"p": "!"}}, {"field": "x", "api": "none", "output_field": "e"}]
    out = services.enriched_all(df, config, {"s": "n string"}, {"s": say})
    assert set(out.columns) == {"id", "x", "y", "r", "told", "b", "d", "e"}
    got = sorted(((r.id, r.told and r.told.n, r.b and r.b.n, r.r and [(x.k, x.v, x.c and x.c.n) for x in r.r], r.d and r.d.n, r.e) for r in out.collect()), key=str)
    one = (1, "a", "b", [("a", 1, "a"), (None, 2, None), ("slow", 3, "slow")], "a!", None)
    assert got == [one, one, (2, "a", None, None, "a!", None), (3, None, None, [], None, None), (4, None, None, [("b", 1, "b")], None, None)]
    calls = sorted(x.name for x in seen.iterdir())
    assert [c for c in calls if c.startswith("a-")] == ["a-0"] and len([c for c in calls if c.startswith("slow")]) == 3 and len([c for c in calls if c.startswith("down-")]) == 3


def test_no_rows(spark):
    df = spark.createDataFrame([], "x string")
    assert services.enriched_all(df, [{"field": "x", "api": "s", "output_field": "o"}], {"s": "n int"}, {"s": lambda *_: {"n": 1}}).where(F.col("o").isNull()).count() == 0
