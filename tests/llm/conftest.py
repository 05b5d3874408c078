import pytest

DOC_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, extra=""):
    """Documents table from (doc_id, text, source) rows."""
    data = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(data, DOC_DDL)


@pytest.fixture
def docs(spark):
    return lambda rows: documents(spark, rows)
