import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, node string, score string, shard string, a int, b int, row_number int"
WORDS = "the quick brown fox jumps over the lazy dog while seven wizards boil green tea near a quiet harbour and count their silver coins again".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns whose names clash with the operators'."""
    texts = [None, "", "   ", "!!! ???", "one", "One two", " ".join(WORDS), " ".join(WORDS), " ".join(WORDS * 4000), "é" * 5000, "0" * 3000, "İstanbul Σίσυφος ΣΑΣ <|endoftext|> 中文 １２３"]
    rows = [(k, t, "en" if k % 2 else None, None, None, 1, "x", "y", "z", 1, 2, 3) for k, t in enumerate(texts)]
    rows += [rows[6], (None, "a text without an id", None, None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
