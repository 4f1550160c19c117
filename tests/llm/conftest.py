import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts, or from (doc_id, text, source) rows."""

    def make(rows, partitions=3):
        full = [(r if isinstance(r, tuple) else (k, r, f"s{k % 3}")) for k, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in full], SCHEMA).repartition(partitions)

    return make


ODD = [None, "", "   \n\t", "one", "Two words", "a b c d e f g", "x" * 50_000, "é Ü ß Σ ΑΣ", "a\nb\n\nb\r\n", "repeat me please now again", "repeat me please now again"]
