"""Every registered query against its DuckDB oracle on the smallest scale."""
import pytest

import __spark_entry__ as entry
from tests.check import compare, connect
from tests.test_plans import check_shape

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    message, ok = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF, check_shape)
    assert "DIFF" not in message and "COLUMNS" not in message, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
