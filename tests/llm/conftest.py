import pytest

LONG = ("alpha beta gamma delta. " * 30 + "epsilon zeta eta theta\n") * 40
ODD = [(1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "fr", None),
       (5, "é 中文 \U0001f642 naïve İ Σς </turn> <|endoftext|> \x1c x\x85y", "de", "b"), (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a"),
       (None, "no id here at all, only words", "en", "c"), (6, LONG, "en", "a"), (7, "one", "es", "a"), (8, "\\ ### 12 $$ %% && ||", None, "a")]


@pytest.fixture
def docs(spark):
    """Nulls, empties, repeated rows, a long text, and columns whose names clash with those that operators use inside."""
    rows = [(*r, 0, "x", 1.5, [1], True) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, fp string, score double, keys array<int>, kept boolean")


@pytest.fixture
def empty(docs):
    return docs.limit(0)

