import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

from cinelake import plans  # noqa: E402

NAMES = list(plans.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["file_id", "frames", "gops", "longest_p_run", "no_reference"]
