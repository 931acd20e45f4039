import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture
def frame(spark):
    """Rows of documents with extra columns whose names clash with what operators make."""
    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_words bigint, start string, component_id string, "
             "_text string, _hash string, _pieces string, _runs string, _html string, _words string, _copy string, _dropped string, _ID string"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)
    return make
