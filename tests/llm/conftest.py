import pytest

pytest.importorskip("bandweave.llm")

ODD = ["", " \t\n ", "one", "one two", "The  The the", "é ü 日本語 x", "a\x00b c", "x" * 50_000, "word " * 30_000, None]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows -> a table like documents, with clashing and extra columns."""

    def make(rows, source="s"):
        full = [(i, t, "en", source, len(t or ""), True, 1.0, "extra") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, size string")

    return make


@pytest.fixture(scope="session")
def odd_documents(documents):
    """Null, empty, wordless, very long, repeated and tied texts, and a row twice."""
    return documents([*enumerate(ODD), (3, ODD[3]), (20, ODD[3]), (21, "one two")])
