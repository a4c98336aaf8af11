import pytest

#: Columns that operators make too, as unrelated columns of the input.
CLASHING = ", 1 AS kept, 'x' AS spans, 2 AS shard, 3 AS start, 'y' AS value, 4 AS label, 5 AS n_words, 6 AS base, 7 AS key"


@pytest.fixture
def table(spark):
    """A table of documents from (doc_id, text) pairs, with extra columns of clashing names."""

    def make(rows, source="s", name="documents"):
        df = spark.createDataFrame([(i, t, "en", source if isinstance(source, str) else source[k], len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", *(x.strip() for x in CLASHING.split(",")[1:]))

    return make


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd():
    """Null, empty and blank texts, null and repeated ids, repeated rows, one very long text, signs of several bytes."""
    return [(None, "one two three"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "é ü 日本語 \U0001f600 x"), (4, "é ü 日本語 \U0001f600 x"), (4, "another text"), (5, "word " * 60_000), (6, "a\nb\na\nb\n\n\nb"), (7, "x" * 100_000), (None, None)]
