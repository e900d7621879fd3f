import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text) pairs."""

    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("kept as it is"))
        return df

    return make
