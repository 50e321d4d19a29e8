import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.\nSecond line of the first text here.", "en"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.\nSecond line of the first text here.", "en"),
    (3, "", "de"),
    (4, None, "de"),
    (5, LONG, "fr"),
    (None, "A text whose number is missing.", None),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.\nSecond line of the first text here.", "en"),
    (6, "   \n\t  ", None),
]


@pytest.fixture
def docs(spark):
    """Nulls in every column, an empty and a very long text, copies, a repeated row, columns with clashing names."""
    rows = [(i, t, x, "a", "b", 1.0) for i, t, x in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, th string, score double")


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
