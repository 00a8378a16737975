import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows and clashing column names."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old mill near the river bank today\n" * 2
    rows = [
        (1, base + "first ending line of the text here", "en", "a", 1), (2, base + "first ending line of the text here", "en", "a", 1), (2, base + "first ending line of the text here", "en", "a", 1),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, "  \n\t ", "de", "b", 3), (None, base + "another ending", "en", None, 5), (None, None, None, None, None),
        (6, LONG, None, "b", len(LONG)), (7, "één été à côté — 日本語 😀 ́", "fr", "c", 9), (8, "x" * 100_000, "en", "c", 100_000), (9, "one two three four", "en", "a", 4),
    ]
    names = ("key", "row", "made", "copies", "size", "vertex", "component", "kept", "text2")
    df = spark.createDataFrame([(*r, *([0] * len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
