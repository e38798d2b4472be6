import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 97} tail{i % 89}" for i in range(30_000))
    base = " ".join(f"base{i}" for i in range(60))
    rows = [
        (1, base, "en", "a"),
        (2, None, "en", "a"),
        (3, "", "de", None),
        (4, "   \n\t ", None, "b"),
        (5, long, "en", "b"),
        (6, base, "en", "c"),
        (6, base, "en", "c"),
        (7, base + " one more", None, None),
        (None, "a text without an id", "en", "a"),
        (8, "Ωmega ünd 日本語 text\nsecond line of this one here", "de", "a"),
        (9, "short", "en", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, tree int, size long, line string, token long"
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, 4, "x", 5) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
