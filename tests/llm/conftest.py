import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text and
    extra columns whose names clash with output names."""
    long_text = " ".join(f"w{i % 3000}" for i in range(30_000)) + "\n" + "x" * 200_000
    base = "the cat sat on the mat and then it went away to the river bank again today"
    rows = [
        (0, base, "en", "a", 1),
        (0, base, "en", "a", 1),
        (1, base.upper(), "en", None, 1),
        (2, None, None, "b", None),
        (3, "", "en", "b", 0),
        (4, " \t\n ", "de", "c", 4),
        (5, long_text, "en", "a", 5),
        (None, base + " x", None, None, None),
        (6, "one two", "fr", "c", 7),
        (7, "ONE\x0btwo", "fr", "c", 7),
        (8, "1234 ###", "fr", "c", 7),
        (9, "<|endoftext|> é\x1cx <s> [INST]", "fr", "\U0001f600", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumn("score", F.lit("mine")).withColumn("size", F.lit(1)).withColumn("n_words", F.lit("z"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
