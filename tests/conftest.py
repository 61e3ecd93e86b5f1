import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from baleprice.session import get_session
    s = get_session("local[4]", 8)
    yield s


@pytest.fixture
def rows(spark):
    """Build a DataFrame from dicts with a declared DDL schema."""
    def make(data, ddl):
        return spark.createDataFrame(data, ddl)
    return make
