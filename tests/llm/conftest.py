import pytest

#: Texts that every operator must take: null, empty, blank, long, repeated, odd characters.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "same text here and there again"), (6, "same text here and there again"), (6, "same text here and there again"), (7, "é 日本語 😀 \x00 x"), (None, "no id")]


@pytest.fixture
def odd(spark):
    """Odd rows with extra columns whose names clash with those of the operators."""
    rows = [(i, t, 1.5, "z", 2, "id?", [0]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, lang_pred string, n int, id string, bands array<int>")


@pytest.fixture
def empty(odd):
    return odd.where("false")
