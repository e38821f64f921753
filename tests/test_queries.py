"""Every registered query against its SQL on the small tables."""
import pytest

import __spark_entry__ as contract
import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    found, sql = contract.queries()[name](spark, SF), contract.oracle_sql().get(name)
    if sql is None:
        assert found.columns and found.count() >= 0
    else:
        assert oracle.compare(found, sql, con) is None


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
