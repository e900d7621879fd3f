"""Steps whose work must not grow faster than their rows, or stay in one task."""

from pyspark.sql import functions as F

from tessella.functions import similarity
from tessella.operators import languages, ledger, pages, places


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_filled_reads_no_frame_for_each_page(spark):
    rows = spark.range(20).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.when(F.col("id").isin(3, 9), F.col("id").cast("string")).alias("v"))
    made = pages.filled(rows, "doc", "page", "v")
    assert "currentrow$(), unboundedfollowing$()" not in plan(made)
    assert [r.filled for r in made.orderBy("page").collect()] == ["3"] * 9 + ["9"] * 11


def test_reconciled_joins_nothing(spark):
    made = ledger.reconciled(spark.createDataFrame([(1,), (2,), (2,), (None,)], "n long"), spark.createDataFrame([(2,), (3,), (3,), (None,)], "n long"), "n")
    assert "join" not in plan(made)
    assert sorted(map(tuple, made.collect())) == [(1, "orphaned_receipt"), (3, "missing_file")]


def test_near_shares_one_file_of_places_among_tasks(spark):
    left = spark.range(0, 400, 1, 1).select("id", (F.col("id") * 0.001).alias("x"), F.lit(0.0).alias("y"))
    made = places.near(left, left.limit(3), "x", "y", 0.005)
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert sorted((r.l.id, r.r.id) for r in made.collect()) == [(i, j) for i in range(400) for j in range(3) if abs(i - j) <= 5 and abs(i * 0.001 - j * 0.001) <= 0.005]


def test_canonical_values_score_the_same(spark):
    rows = spark.createDataFrame([(" USA ", "United States"), (None, "x"), ("", " "), ("Berlin", "berlin ")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    own = places.weighted([(a, b, 10), (b, a, 5)], similarity.by_levenshtein)
    ready = [similarity.canonical(c) for c in (a, b)]
    told = places.weighted([(ready[0], ready[1], 10), (ready[1], ready[0], 5)], similarity.by_levenshtein, told=True)
    level = places.parent_score([a, b], [b, a, a], places.PARENT_WEIGHTS, 1, similarity.by_levenshtein)
    told_level = places.parent_score(ready, [ready[1], ready[0], ready[0]], places.PARENT_WEIGHTS, 1, similarity.by_levenshtein, told=True)
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows.select(own, told, level, told_level).collect())


def test_profiles_read_texts_once(spark):
    df = spark.createDataFrame([(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en")], "doc long, text string, lang string")
    names, profile = languages.fit(df, "text", "lang")
    assert names == ["de", "en"] and "text" not in plan(profile).replace("textfile", "")


def test_spatial_match_of_dense_places_makes_no_pairs(spark, tmp_path, monkeypatch):
    from tessella.plans import catalogue  # noqa: F401  registers its queries
    from tessella.plans.registry import CATALOGUE

    place = (F.col("id") * 37 % 250).cast("double")
    spark.range(900).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.lit("m").alias("c_mktsegment"), place.alias("c_acctbal"), F.lit(3).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(700).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), place.alias("s_acctbal"), F.lit(3).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(places, "near", None)  # all pairs within the tolerance: 630,000 here
    got = {}
    for r in CATALOGUE["spatial_match"][0](spark, str(tmp_path)).collect():
        got.setdefault(r.c_custkey, {})[r["rank"]] = (r.distance, r.s_suppkey)
    for c in (0, 17, 899):
        best = sorted((((c * 37 % 250 / 1000 - s * 37 % 250 / 1000) ** 2) ** 0.5, s) for s in range(700))[:5]
        assert [s for _, s in best] == [got[c][i][1] for i in range(1, 6)] and len(got) == 900


def test_keyed_state_travels_with_the_rows(spark, tmp_path):
    from tessella.streaming import calls

    rows = spark.createDataFrame([("a", 0, "request", 1)], "k string, t long, kind string, seq long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    rows.write.parquet(f"{tmp_path}/in")
    made = calls.next_actions(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "k")
    told = made._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in told and "TransformWithState" not in told  # the latter asks the store for each key
