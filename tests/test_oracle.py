"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import pytest
from oracle import connect, difference

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()
SLOW = {"train_svm", "train_gbt", "train_gbt_depthwise", "feature_importances", "cross_validation", "model_ranking"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert difference(spark, duck, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).toArrow().num_rows > 0


def test_entry(spark):
    rows = contract.entry(spark).toArrow()
    assert 0 < rows.num_rows <= 50
    assert "extension_family" in rows.column_names
