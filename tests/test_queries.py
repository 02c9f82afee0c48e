"""Every registered query against its SQL, on the smallest tables."""

import pytest

import check_queries
from framewise.plans.catalog import QUERIES, SQL

SLOW = {"linear_probe", "linear_probe_on_projection", "l2_grid_selection", "l2_winner_metrics"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return check_queries.duck(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, sf_dir, name):
    ok, text, _ = check_queries.compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
    assert ok is not False, text


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "segment" and df.count() > 0
