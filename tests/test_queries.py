"""Every registered query against its SQL on the smallest given tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import check  # noqa: E402
from catalink.plans.catalogue import all_queries, all_sql  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.tables(SF)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, con, name):
    got = all_queries()[name](spark, SF).toPandas()
    assert check.compare(got, con.execute(all_sql()[name]).df()) == "ok"


@pytest.mark.parametrize("name", ["link_by_svd", "link_by_factors", "svd_several_k"])
def test_query_without_sql_gives_rows(spark, name):
    assert all_queries()[name](spark, SF).count() > 0


def test_every_check_has_its_query():
    assert set(all_sql()) <= set(all_queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["post_id", "item_id", "similarity"]
