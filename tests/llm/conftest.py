"""Small documents with everything that operators must bear: nulls, empty and long texts, repeated rows, clashing columns."""

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
)
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", None, "b", 6),
    (4, "hello hello world\nhello again", "en", "b", 29),
    (4, "hello hello world\nhello again", "en", "b", 29),
    (4, "another text under the same id", "en", None, 30),
    (None, "no id at all", "en", "b", 12),
    (5, "Ünïcödé ça va? 日本語 🙂 <|endoftext|> end", "fr", "c", 40),
    (6, "word " * 30_000, "en", "a", 150_000),
    (7, "x" * 100_000, "en", "a", 100_000),
    (8, "\n" * 5000, "de", "c", 5000),
    (9, "123 456 !!! ???", "de", "c", 15),
]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("score", "runs", "copy", "row", "label", "node", "id", "u", "Predicted", "lines", "block", "key"):
            df = df.selectExpr("*", f"'kept' AS {name}")
    return df


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def odd_extra(spark):
    return frame(spark, ODD, extra=True)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
