import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, n bigint, id bigint, spans string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} of" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta.", "en", "b", 3, 1, 1, 1, "x"),
        (1, "Alpha beta gamma delta epsilon zeta.", "en", "b", 3, 1, 1, 1, "x"),
        (2, "alpha BETA gamma delta epsilon zeta.", None, "a", None, None, None, None, None),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, 0, 0, 0, ""),
        (5, " \t\n ", "en", "a", 0, 0, 0, 0, ""),
        (6, "one two", "en", "é", 0, 0, 0, 0, ""),
        (7, "one two", "en", "b", 0, 0, 0, 0, ""),
        (8, long_text, "en", "b", 0, 0, 0, 0, ""),
        (9, "Ünïcode ſ K 日本語 <|endoftext|> don't", "xx", "c", 0, 0, 0, 0, ""),
        (None, "a row without an id at all", None, "c", 0, 0, 0, 0, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
