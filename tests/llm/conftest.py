import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names an operator might use inside.
CLASH = ["id", "fp", "key", "grp", "size", "shard", "slot", "rate", "a", "b", "n", "p", "w", "line", "part", "digest"]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        rows = [(i, t, "en", s, len(t) if t is not None else None) for i, t, *rest in rows
                for s in [rest[0] if rest else "s"]]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASH])
        return df
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeats, ties, a very long text."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    return [(None, None), (1, None), (2, ""), (3, "   \t\n "), (4, "one two three four five six"),
            (4, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"),
            (6, long), (7, "日本語 \U0001f600 éè\n\nline two of the text\nline two of the text"), (8, "x")]
