"""Every registered query against its SQL oracle, on the smallest test data."""

import pandas as pd
import pytest

import __spark_entry__ as contract
from poselytics.plans.queries import QUERIES
from tests.compare import difference, duck, rows
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def oracle():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    result = rows(contract.queries()[name](spark, SMALL))
    found = oracle.execute(contract.oracle_sql()[name])
    expected = pd.DataFrame(found.fetchall(), columns=[d[0] for d in found.description], dtype=object)
    assert difference(result, expected) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
