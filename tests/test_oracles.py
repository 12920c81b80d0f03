"""Every registered query against its SQL twin, on whole tables."""

import compare
import pytest

import __spark_entry__ as entry_point
from fanchart.plans.oracles import oracle_sql
from fanchart.plans.queries import registered

QUERIES, SQL = registered(), oracle_sql()
FITTED = {"quantile_gbt_onehot", "quantile_gbt_target", "hyperparameter_search"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


def test_only_fitted_trees_lack_sql():
    assert set(QUERIES) - set(SQL) == FITTED
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, sf_dir, name):
    assert compare.differences(spark, con, sf_dir, QUERIES[name], SQL[name]) == []


def test_entry(spark):
    df = entry_point.entry(spark)
    assert set(df.columns) == {"date", "sku", "promo_flag", "p10", "p50", "p90"}
    rows = df.collect()
    assert len(rows) == 12 * len({r.sku for r in rows})
    assert all(0 <= r.p10 <= r.p50 <= r.p90 for r in rows)
