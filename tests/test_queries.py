"""Every query of the library's own operators against its SQL on the smallest tables."""

import os

import pytest
from oracle import duckdb_on, same

from skein import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duckdb_on(SF)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, con):
    df = plans.queries()[name](spark, SF)
    if name in plans.oracle_sql():
        same(df, con, plans.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_evaluate_cases_without_broadcasts(spark, con):
    """As on larger tables, where joins are by shuffles: results are a union of two sides with the cases as their keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(plans.queries()["evaluate_cases"](spark, SF), con, plans.oracle_sql()["evaluate_cases"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
