"""Every named query on the smallest tables: same columns, rows and values as its SQL statement."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from quantspan.oracle import ORACLE
from quantspan.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def _rows(df):
    def cell(x):
        if pd.isna(x):
            return None
        return float(x) if isinstance(x, (int, float, np.integer, np.floating, np.bool_, bool)) else str(x)

    cols = sorted(df.columns)
    return sorted((tuple(cell(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


def test_statements_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    got = QUERIES[name](spark, data).toPandas()
    want = sql.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark, data):
    df = entry_module.entry(spark)
    assert df.count() == 5 and "verdict" in df.columns
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_plans(spark, data):
    """Filters and columns reach the scan, and no ordered step windows a whole table."""
    plan = QUERIES["bars_hourly"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(value)]" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    for name in ("equity_gates", "rolling_vol", "kill_switch", "asof_gates", "recent_trades", "latest_orders"):
        physical = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in physical or name == "recent_trades"
        assert "CartesianProduct" not in physical and "NestedLoop" not in physical
