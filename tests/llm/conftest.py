import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (id, text) pairs; the rest of the columns is made up."""

    def docs(rows, extra=False):
        full = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that operators use within
            for name in ("id", "size", "start", "key", "_id", "_spans", "part", "signature", "component"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return docs
