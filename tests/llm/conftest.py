import pytest

#: Columns whose names the operators use inside, to clash with.
EXTRA = {"u": 1, "v": "x", "h": 2.0, "n": 3, "seq": "s", "sig": "s", "words": "w", "t": "t", "part": 1, "at": 2, "spans": "s", "block": 0, "score": 1.0, "component_id": 7, "kept": False}
KINDS = "u int, v string, h double, n int, seq string, sig string, words string, t string, part int, at int, spans string, block int, score double, component_id int, kept boolean"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text), with further columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *EXTRA.values()) for i, t in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {KINDS}")

    return make
