import pytest
from pyspark.sql import functions as F

ODD = [
    (1, "the cat sat on the mat and then it went away again", "en", "s1"),
    (2, "The cat sat on the mat and then it went away again", "en", "s1"),
    (3, None, "en", "s2"),
    (4, "", None, None),
    (5, "  \n\t ", "de", "s1"),
    (6, "one two three", "en", "s1"),
    (6, "one two three", "en", "s1"),
    (7, "word " * 30_000, "en", "s3"),
    (8, "ünï çödé \U0001f642 text mit Umlauten über alles", "de", "s2"),
    (None, "a row without an id but with enough words to matter", "en", "s1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in ("score", "n_tokens", "row", "key", "id", "mark", "probability", "topic", "ids")}).withColumn("n_chars", F.length("text").cast("long")).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
