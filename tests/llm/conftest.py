"""Tables with the awkward cases: nulls, empty, repeated and long texts, and clashing column names."""

import pytest

LONG = " ".join(f"w{i % 977} and so on" for i in range(6000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards box a jumping quartz sphinx and leave quietly again"


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "   \n\t ", "en", None),
        (4, "Hello World hello", "en", "a"),
        (5, "hello world HELLO", "en", "a"),
        (5, "hello world HELLO", "en", "a"),
        (6, "hello world HELLO", None, "b"),
        (None, "hello world hello", "fr", "b"),
        (7, LONG, "en", "a"),
        (8, LONG + " tail", "en", "a"),
        (9, PASSAGE + " one", "en", "a"),
        (10, "zwei " + PASSAGE + " drei " + PASSAGE, "de", "a"),
        (11, "É é İ ﬁ 漢字 \U0001f600 x", "fr", "c"),
        (12, "12345 --- !!!", "de", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # Names that differ in case only, or that the operators use inside.
    from pyspark.sql import functions as F

    return df.select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("_in0"), F.lit(2).alias("bucket"), F.lit(3).alias("fingerprint"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts_of(df):
    at = df.columns.index("text")
    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return [(r[0], r[at]) for r in by_place.collect()]
