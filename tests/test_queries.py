"""Every registered query against its SQL, on the smallest scale."""

import pytest

import __spark_entry__ as e
from tests.conftest import TESTDATA
from tests.verify import compare, connect
from workloads.checks import CHECKS
from workloads.queries import registered

FOLDER = TESTDATA / "sf0.001"

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(registered()) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_equals_its_sql(spark, con, name):
    problem, _, _ = compare(spark, con, name, str(FOLDER))
    assert problem is None, problem


def test_entry(spark):
    assert e.entry(spark).columns[0] == "migration_key"
