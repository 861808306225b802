"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import assert_same, connect

import __spark_entry__ as contract
from entitymill.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
# Their own tests train models, and r8 is part of r9.
SLOW = {"ml2_leaf_wise_gbt", "ml2_patience", "ml5_published_net", "ml7_published_search", "ml3_depth_wise_gbt", "ml4_random_forest", "ml5_dense_net",
        "ml7_search", "ml8_score_trace", "ml9_importances", "r8_cross_table"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    assert_same(got, duck.execute(contract.oracle_sql()[name]).df())
