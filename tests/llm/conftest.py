import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n_words long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with names that operators use."""
    base = "the quick brown fox jumps over the lazy dog and runs away from a big bear"
    rows = [
        (1, base, "en", "a", 5, 0.5, "x", 1),
        (1, base, "en", "a", 5, 0.5, "x", 1),
        (2, base, "en", "b", 5, None, None, None),
        (3, None, "en", None, None, 0.1, "y", 2),
        (4, "", None, "c", 0, 0.1, "y", 2),
        (5, " \t\n ", "de", "c", 0, 0.1, "y", 2),
        (6, "one two", "de", "c", 0, 0.1, "y", 2),
        (7, "ONE two", "de", "c", 0, 0.1, "y", 2),
        (None, base + " now", None, "c", 0, 0.1, "y", 2),
        (8, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "d", 9, 0.2, "z", 3),
        (9, "é" * 3000 + " 😀 ﬁn İstanbul Σίσυφος ΟΔΟΣ it's we'll <|endoftext|> x y z é", "el", "d", 9, 0.2, "z", 3),
        (10, "9" * 5000 + " " + "a" * 20000 + " " + "1.2." * 3000 + "+" * 500, "en", "d", 9, 0.2, "z", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
