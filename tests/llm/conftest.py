import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, id string, label string, value string, start string, bin string"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with the names operators use inside."""
    long = " ".join(f"word{i % 977} und {i}" for i in range(30000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a"), (1, "one two three four five six seven eight nine ten", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, "   \n\t ", "de", "b"), (None, "no id here, but some words all the same", "en", "c"),
        (None, None, None, None), (5, long, "en", "a"), (6, long + " tail", "en", "a"), (7, "12345 67890", "fr", "b"),
        (8, "one two three four five six seven eight nine ten", "en", "z"), (9, "ümläut é 日本語 \U0001f600 x", "de", "b"), (10, "a", "en", "b"),
    ]
    return spark.createDataFrame([(*r, None, "x", "y", "z", "v", "s", "b") for r in rows], DOC_SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
