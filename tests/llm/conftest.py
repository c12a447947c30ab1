import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Texts that every operator must take: NULL, empty, blank, ties, very long.
ODD = [None, "", " \n\t ", "\n\n", "one", "one", "x" * 200_000, "word " * 20_000, "é漢🙂\x00​"]


@pytest.fixture
def documents(spark, tmp_path_factory):
    """Make documents of (id, text, source) rows, with extra columns whose names clash with the operators' own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")

    def make(rows, extra=True):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", "'x' AS size", "1 AS id", "2 AS row", "3 AS key", "'y' AS score", "0 AS shard", "'z' AS bytes") if extra else df

    return make


@pytest.fixture
def odd(documents):
    """Odd texts, NULL ids and sources, repeated rows."""
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(ODD)]
    return documents([*rows, rows[5], rows[5], (None, "one", "s"), (None, None, None)])


@pytest.fixture
def empty(documents):
    return documents([])
