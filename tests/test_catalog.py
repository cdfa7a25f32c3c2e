import pytest
from compare import assert_same, database

from tallyforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name])


def test_status_counts_follow_the_derivation(spark):
    rows = {r["status"]: r["n"] for r in catalog.QUERIES["run_outcome"](spark, "/root/testdata/sf0.01").collect()}
    assert rows == {"current": 463, "new": 73, "replaced": 39, "mismatch": 10, "not_landed": 9, "rejected_path": 6}
