import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, size string, fp string, component_id string, taken string, score string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, copies, clashing names."""
    words = [f"w{i * 7919 % 1009}" for i in range(30_000)]
    rows = [
        (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"), (2, "One TWO three four\tfive six seven", "en", None),
        (3, None, "en", "b"), (4, "", None, "b"), (5, " \n\t ", "en", "b"), (None, "a null id", "en", "c"), (None, None, None, None), (6, " ".join(words), "en", "a"),
        (7, " ".join(words), "en", "c"), (8, "x" * 50_000, "en", "a"), (9, "naïve 日本語 😀 text.\nnaïve 日本語 😀 text.", "en", "b"), (10, "two words", "en", "c"), (10, "other text here", "en", "c"),
    ]
    rows = [(*r, len(r[1] or ""), "h", None, "f", "c", "t", "s") for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(messy):
    return messy.where(F.lit(False))


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").cache()
