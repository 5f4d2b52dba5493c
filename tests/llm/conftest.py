import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs(spark):
    """documents-like rows with the awkward cases every operator must take."""
    def make(texts, start=0, **extra):
        rows = [(None if t == "NULLID" else i + start, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return make


@pytest.fixture(scope="session", autouse=True)
def _prepared(spark):
    from pagesift.llm.common import prepare, remove_work_tables
    prepare(spark)
    yield
    remove_work_tables(spark)
