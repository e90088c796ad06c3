import pytest

LONG = ("word " * 3000).strip()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.\nThe quick brown fox jumps.", "en", "a", 7),
        (2, None, None, None, 7),
        (3, "", "en", "a", 7),
        (4, LONG, "en", "b", 7),
        (5, "  two  spaces \n\n and\ttabs\x00 here ", "de", "b", 7),
        (5, "  two  spaces \n\n and\ttabs\x00 here ", "de", "b", 7),
        (6, "Größe 日本語 \U0001f600 <|endoftext|> <s> ▁x Licensed under CC BY-NC 4.0. MIT License", "de", "c", 7),
        (7, " ", "en", "c", 7),
        (8, "a", "en", None, 7),
        (None, "no id here", "fr", "c", 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (6, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
