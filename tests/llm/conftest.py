import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars int, id long, fp long, row string, size int, tag string, "
    "`key` string, n int, rest string, lines string, language string, u int"
)
EXTRA = (7, 8, "r", 9, "t", "k", 1, "x", "l", "xx", 5)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, lang[, source]]) with extra columns whose names the operators use inside."""

    def make(rows):
        full = []
        for doc, text, *more in rows:
            lang, source = [*more, *["en", "s"][len(more) :]]
            full.append((doc, text, lang, source, None if text is None else len(text), *EXTRA))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, a null id, a very long text, repeated rows, equal texts and equal ids."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    plain = " ".join(rng.choice(words) for _ in range(90)) + "."
    return [
        (1, None), (2, ""), (3, "  \n\t "), (None, plain), (4, long), (5, plain), (5, plain), (6, plain), (6, "another text of one id"),
        (7, "one"), (None, None), (8, "line a b c\nline d e f\nother\nline a b c\nline d e f"),
    ]

