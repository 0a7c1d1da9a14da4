import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, kept string"
LONG = "lorem ipsum dolor sit amet " * 6_000


def make(spark, rows):
    """A table of (doc_id, text) with the other columns of documents and two with names that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows], COLUMNS)


@pytest.fixture
def docs(spark):
    return lambda rows: make(spark, rows)


#: Nulls, empty and very long texts, ties, repeated rows, a null identifier, characters outside the BMP.
EDGES = [
    (1, "Hello World, hello world. This is one text of some words."), (2, "hello world, HELLO world. this is one text of some words."), (3, None), (4, ""), (5, " \t\n "), (6, LONG), (7, LONG),
    (8, "a\nb\na\nb\na"), (8, "a\nb\na\nb\na"), (None, "no id here"), (9, "\U0001f600 émoji ﬁn   wide space İ"), (10, "!!!"), (11, "Ünïcödé " * 40), (12, "x"),
]
