import pytest

#: Rows that every operator meets: null and empty texts, a very long one, repeated rows, equal texts, odd characters.
TEXTS = [None, "", " ", "a", "The cat sat on the mat.", "The cat sat on the mat.", "x" * 50_000, "word " * 20_000, "\x00\x01 \t tabs\n\n\nlines   no-break", "日本語 😀 é <|endoftext|> 1d10t", "  two  spaces  "]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """More columns, with names that operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["fp", "root", "items", "contaminated", "n_words", "host", "leaf", "word", "ids", "score", "part", "n_lines", "n_dropped", "kept_text", "key", "v", "w", "at", "ws", "h", "row", "found"]
    return odd_docs.select("*", *(F.lit(n).alias(n) for n in names))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
