import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns whose names clash with results."""
    words = [f"w{i * 7919 % 1000}" for i in range(20_000)]
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 60),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 60),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " ".join(words), "en", None, 1),
        (5, "x" * 100_000, "en", "b", 100_000),
        (None, "the quick brown fox jumps over the lazy dog again and again", "en", "c", 60),
        (None, None, None, None, None),
        (7, " \n\t ", "en", "b", 4),
        (8, "ümlaut 😀 é́ 　 mixed\nline\nline\nline", "de", "zé", 20),
        (9, "A b c d", "en", "b", 7), (10, "a B C D", "en", "b", 7), (11, "a\x00b | # $", "en", "b", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {"score": 1, "fp": 2, "size": 3, "taken": 4, "kept": 5, "component_id": 6, "ids": 7, "slot": 8, "shard": 9, "kind": 10, "n_words": 11}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()}).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def few(spark):
    """The smallest documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
