import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of the texts given, with repeated rows, nulls in any column, and extra columns whose names clash with results."""

    def make(texts, first=100):
        rows = [(first + i, t, "en" if i % 3 else None, f"src{i % 5}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.selectExpr("*", "1 AS n_tokens", "'x' AS spans", "2 AS score", "'y' AS row", "3 AS key", "4 AS n_words")

    return make


@pytest.fixture(scope="session")
def odd():
    """Empty, null, blank, very long, repeated and awkward texts."""
    return ["", None, " \n\t ", "a" * 60_000, "x", "x", "1 " * 20_000, "word " * 10_000, "ünïcødé 日本語 😀 ´ ½", "\x00\x01\x85\xa0 end", "same text here for all", "same text here for all"]
