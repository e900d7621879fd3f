import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import languages

DATA = "/root/testdata/sf0.01"


def test_languages_of_documents_that_were_not_fitted(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    # Copies stay on one side: sides are dealt by the text's first words.
    side = F.pmod(F.xxhash64(F.slice(F.split("text", r"\s+"), 1, 5)), F.lit(2))
    given, held = docs.where(side == 0), docs.where((side == 1) & (F.length(F.trim("text")) >= 200))
    got = languages.told(held, "doc_id", "text", *languages.fit(given, "text", "lang")).join(held, "doc_id")
    right, n = got.agg(F.count_if(F.col("told") == F.col("lang")), F.count("*")).first()
    assert n > 200 and right / n > 0.97


def test_short_texts_nulls_and_no_labels(spark):
    texts = [(1, "the cat and the dog sat on the mat and they were glad of it", "en"), (2, "der Hund und die Katze lagen auf der Matte und waren froh", "de"), (3, "the", "en"), (4, None, None), (5, "12345 67890 12345 67890 12345 67890 12345 67890", None), (6, "und die Katze war froh über den Hund auf der Matte", None)]
    df = spark.createDataFrame(texts, "id int, t string, lang string")
    names, profile = languages.fit(df, "t", "lang", most=50)
    assert names == ["de", "en"] and profile.count() <= 100
    got = dict(languages.told(df, "id", "t", names, profile).collect())
    assert got == {1: "en", 2: "de", 3: None, 4: None, 5: None, 6: "de"}
    none = languages.fit(df.where("lang = 'x'"), "t", "lang")
    assert none[0] == [] and languages.told(df, "id", "t", *none).where("told IS NOT NULL").count() == 0


def test_grams_of_a_word(spark):
    row = spark.range(1).select(languages.grams(F.lit("äb")), languages.grams(F.lit(""))).first()
    assert row[0] == ["_", "ä", "b", "_", "_ä", "äb", "b_", "_äb", "äb_"] and row[1] == ["_", "_", "__"]
