"""The corpus queries that SQL can express, against DuckDB, and the pipeline's stages."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from tablescope.llm import queries
from tablescope.llm.common import table, written


@pytest.mark.parametrize("name", queries.SQL)
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns)) for r in want.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == rows


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] > kept[1] == kept[2] >= kept[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.where("piece = 0").count() == kept[4]
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()


def test_pipeline_of_nothing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
