"""Every registered query beside its SQL counterpart on the smallest driver tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

import check_sql  # noqa: E402

from freshet.catalog.registry import QUERIES, SQL  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
contract = check_sql.contract

# no SQL form: trees, a penalty search over several features, and reports built on them
WITHOUT_SQL = {
    "forest", "weighted_forest", "regime_blend", "boosted_trees", "daily_forecast", "monthly_forecast",
    "lasso_cv_daily",
}


@pytest.fixture(scope="module")
def duck():
    if not Path(SF_DIR).exists():
        pytest.skip("driver tables are not here")
    con = duckdb.connect()
    for t in check_sql.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(SQL) <= set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ok, note = check_sql.compare(spark, duck, name, SF_DIR)
    assert ok, note


def test_entry(spark, duck):
    df = contract.entry(spark)
    assert df.count() > 0 and "inflow_next30" in df.columns
