import pytest


@pytest.fixture
def docs(spark):
    """Nulls, empty and long texts, ties, copies, repeated rows, and columns that clash with the operators' own."""
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, "the quick brown fox jumps over the lazy dog", 5), (2, "the quick brown fox jumps over the lazy dog", 6), (3, None, 7), (4, "", None), (5, long, 1), (6, long + " end", 1), (7, "  \n\t ", 1), (8, "Ünï çödé 日本 😀 x²", 1), (8, "Ünï çödé 日本 😀 x²", 1), (None, "no id here at all", 2), (9, "a", 1)]
    return spark.createDataFrame([(i, t, s, "x", 0) for i, t, s in rows], "doc_id long, text string, score long, kept string, n_words int")


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
