import pytest

LONG = "alpha beta gamma delta " * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "  \n\t ", None, None, None),
        (4, LONG, "en", "s", 1), (5, LONG, "en", "s", 1), (None, "one two three", "en", "s", 1),
        (None, "one two three", "en", "s", 1), (6, "one two three", "fr", "t", 1),
        (7, "Same row.", "en", "s", 1), (7, "Same row.", "en", "s", 1), (8, "0123 4567", "en", "s", 9),
        (9, "x" * 5_000, None, "s", 1), (10, "日本語 \U0001F600 é́", "ja", "s", 1),
        (None, None, None, None, None), (11, "it's <|endoftext|> ##!! \x1c    z", "en", "s", 2),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with further columns that have names the operators use."""
    names = (
        "digest kept score held_out fp root row w h c cw ids dedup dedup_digest dedup_mark dedup_hit simhash_fp "
        "simhash_hit quality_verdict language_guess quality_log_odds quality_site host path p body tokens"
    ).split()
    out = odd
    for name in names:
        out = out.withColumn(name, odd["n_chars"])
    return out.withColumn("a.b", odd["n_chars"])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (4, 1, 1), (6, 0, 0), (7, None, None), (None, 1, 1), (8, 1, 0), (8, 0, 0)], LABELS
    )


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)
