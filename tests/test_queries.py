"""Every registered query against its SQL on the given tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, con, name):
    problem = difference(spark, SF, con, contract.queries()[name], contract.oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    assert contract.entry(spark).count() > 0
