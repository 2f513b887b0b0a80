import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]]) rows."""

    def f(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return f


@pytest.fixture()
def crowded():
    """Adds columns whose names operators might use themselves."""

    def f(df):
        for n in ("match", "language", "secrets", "figures", "tokens", "mix", "doc_key", "doc_rules", "component", "bucket", "key", "a", "b", "cell_", "cell_source", "topic"):
            df = df.withColumn(n, F.lit("x"))
        return df

    return f
