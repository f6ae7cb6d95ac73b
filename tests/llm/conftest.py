import pytest

from forgelake.llm.common import prepare

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a table like ``documents`` from (doc_id, text) or (doc_id, text, lang, source) rows."""
    prepare(spark)

    def make(rows, extra=""):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        return df.selectExpr("*", *([extra] if extra else []))

    return make
