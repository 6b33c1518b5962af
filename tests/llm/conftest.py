import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with columns whose
    names clash with what the operators add."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a",
                 None if r[1] is None else len(r[1]), 1, 2, 3) for r in rows]
        return spark.createDataFrame(
            full, DOCS + ", digest int, size int, `kept.x` int").repartition(parts)
    return make


#: Nulls, empty and blank texts, ties, repeated rows, a very long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one "), (6, "o n e"), (None, "one"),
    (7, "Ärger über die Straße und der Hund"), (8, "the cat sat on the mat " * 3),
    (9, "word " * 60_000), (10, "###"), (11, "1234"), (None, None), (2, ""),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)
