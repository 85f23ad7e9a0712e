import pytest

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000))
ODD = [
    (1, None, None, None, None), (None, "one two three", "en", "a", 13), (2, "", "en", "a", 0), (3, "  \n\t ", None, "b", 4),
    (4, "### $$$ !!!", "en", None, 11), (5, LONG, "en", "a", len(LONG)), (6, "the same words again and again", "en", "b", 30),
    (6, "the same words again and again", "en", "b", 30), (7, "the same words again and again", "en", "b", 30),
    (8, "Ünïcode wörter über alles ß", "de", "c", 27), (None, None, None, None, None), (None, "one two three", "en", "a", 13),
]


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from rows."""
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and very long texts, repeated rows."""
    return documents(ODD).coalesce(2).cache()


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
