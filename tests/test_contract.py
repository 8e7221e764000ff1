"""Queries against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.plans import contract, contract_jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


QUERIES, ORACLE_SQL = contract.QUERIES | contract_jobs.QUERIES, contract.ORACLE_SQL | contract_jobs.ORACLE_SQL


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.execute(f"SELECT * FROM ({ORACLE_SQL[name]})")
    assert sorted(c[0] for c in want.description) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall()) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cells_have_the_recall_that_is_wanted(spark):
    rows = QUERIES["knn_cells"](spark, SF.replace("0.001", "0.1")).select("query_id", "recall").distinct().collect()
    assert len(rows) == 20 and sum(r.recall for r in rows) / len(rows) >= 0.9
