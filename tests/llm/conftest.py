import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as documents with extra columns, one of them named like a result."""

    def make(*rows):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return df.select("doc_id", "text", F.lit(None).cast("string").alias("kept"), F.lit(7).alias("n_words"))

    return make


@pytest.fixture
def by_id():
    def collect(df, key="doc_id"):
        return {r[key]: r for r in df.collect()}

    return collect
