import pytest

SCHEMA = "doc_id long, text string, lang string, source string, key string, fp string, score double, size string"

HARD = [
    (1, "one two three four five", "en", "a", "x", "y", 0.5, "z"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "b", "x", "y", 0.5, "z"),
    (3, "", "en", "b", "x", "y", 0.5, "z"),
    (None, "one two three four five", "fr", None, "x", "y", 0.5, "z"),
    (4, " \t\n\x0b\x0c\r ", "en", "a", "x", "y", 0.5, "z"),
    (5, "ONE  two\nthree four\tfive", "de", "a", "x", "y", 0.5, "z"),
    (6, "é中😀 <|endoftext|> \x1c\x85\xa0", "de", "a", "x", "y", 0.5, "z"),
    (7, "word " * 30_000, "en", "c", "x", "y", 0.5, "z"),
    (-8, "line\nline\nother", "en", "c", "x", "y", 0.5, "z"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
