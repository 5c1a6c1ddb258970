import pytest

NASTY = [
    (1, "the quick brown fox jumps over the lazy dog", "x", "s", 9),
    (2, None, "x", "s", 0),
    (3, "", "x", "s", 0),
    (4, "the quick brown fox jumps over the lazy dog", "x", "s", 9),
    (4, "the quick brown fox jumps over the lazy dog", "x", "s", 9),
    (None, "a row without an id", "x", "s", 9),
    (5, "  \t\n ", None, None, None),
    (6, "long " * 40_000, "x", "s", 9),
    (7, "x" * 150_000, "x", "s", 9),
    (8, "Ünïcödé — 漢字 \U0001f600 don't 12345", "x", "s", 9),
    (9, "cut\x85here and\x1cthere", "x", "s", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def nasty(spark):
    return spark.createDataFrame(NASTY, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(spark):
    """Columns named as operators name their own."""
    cols = "score double, row long, node long, size long, shard int, slot int, base int, spans int, ids int, block int, kept int, label int, words int, _row int, _id int"
    return spark.createDataFrame([(*r, *[0.0], *[0] * 14) for r in NASTY], SCHEMA + ", " + cols)
