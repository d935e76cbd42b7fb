"""Every query of the engine's own operators against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tablescope.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def rows(columns: list[str], found: list) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str(tuple(r[k] for k in order)) for r in found)


@pytest.mark.parametrize("name", catalog.SQL)
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lists_of_texts_bring_no_cells_together(spark, sf_dir):
    from tablescope.plans import grids

    exchanges = lambda rows: rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(grids._lists(spark, sf_dir)) == exchanges(grids.markup_tables(spark, sf_dir)) > 0
