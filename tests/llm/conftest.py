import pytest
from pyspark.sql import SparkSession

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark: SparkSession):
    """Makes a documents table of (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows, source="s", **extra):
        df = spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in rows], DOC)
        return df.selectExpr("*", "1 as n", "2 as size", "'x' as label", "3 as n_shingles", "0.5D as score", "4 as leaks")

    return make
