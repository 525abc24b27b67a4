"""The registered queries against DuckDB on the smallest data; here the shuffles stay split into several chunks."""

import duckdb
import pytest

import __spark_entry__ as contract
from steadyline.plans.oracle import ORACLE
from steadyline.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "orders", "lineitem", "events", "documents", "conversations"]
ROWS_ONLY: set[str] = set()
PROBED = ["a10_suppressed", "b6_rest_gap", "e2_explain", "h3_first_break", "m5_precision_at", "m7_sweep", "q4_consistency", "w2_invalid_actions", "w5_history"]


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql_or_a_reason():
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries)
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "entity_id" and df.count() > 0


@pytest.mark.parametrize("name", PROBED)
def test_same_as_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    rel = con.sql(contract.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    mine = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert mine == sorted([plain(r[i]) for i in at] for r in rel.fetchall())
    assert mine
