import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of small documents tables; rows are (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, extra=False):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "src0")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("key", "node", "class", "at", "label", "row", "group", "band", "chunk"):
                df = df.withColumn(name, df.doc_id)
        return df

    return make


#: Nulls, empty and white-space texts, repeated rows, ties, a long word and a long text.
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (None, "no id here at all, not even one"),
    (5, "one two three"),
    (5, "one two three"),
    (6, "x" * 5000),
    (7, "alpha beta gamma delta epsilon zeta\n" * 300),
    (8, "Ünïcödé ﬁ ½   text 　 here"),
    (9, "same text in two rows, long enough to be cut"),
    (10, "same text in two rows, long enough to be cut"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
