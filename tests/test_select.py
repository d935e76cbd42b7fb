from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablescope.functions import diffs
from tablescope.operators import select


def test_differences():
    a, b = "<tr><td>x</td></tr>", "<tr><td>y z</td></tr>"
    assert diffs.operations(a, b) == [("replace", "x", "y z")] and diffs.operations(a, a) == []
    assert "-<td>x</td>" in diffs.changed_lines(a, b) and diffs.changed_lines(a, a) == []
    assert diffs.tag_lines("<a><b>") == ["<a>", "<b>"] and diffs.shortened("<a><b>", 3) == "<a>…" and diffs.plain("<b>a&amp;</b> c", 3) == "a& "
    rows = "<table><tr><td>1</td></tr><tr><td>2</td></tr><tr class='x'><td>3</td></tr></table>"
    assert diffs.outer_rows(rows, 2) == ["<tr><td>1</td></tr>", '<tr class="x"><td>3</td></tr>'] and len(diffs.outer_rows(rows, 3)) == 3


def test_clusters_and_boundaries():
    assert diffs.centres([], 2) == [] and diffs.centres([1.0], 3) == [1, 1, 1]
    assert diffs.centres([0, 1, 10, 11, 20, 21], 3) == [0.5, 10.5, 20.5]
    assert diffs.grid_edges([0, 5, 9], [], 2, 0, 9) == ([0, 5, 9], "line")
    assert diffs.grid_edges([], [1, 2, 8, 9], 2, 0, 10) == ([0, 5, 10], "distribution")
    assert diffs.grid_edges([], [], 2, 0, 10) == ([0, 5, 10], "uniform")


def test_selections(spark):
    rows = spark.createDataFrame([(k, k / 10, None if k == 5 else k) for k in range(10)], "sample long, teds double, rows int")
    ids = lambda df: [r["sample"] for r in df.collect()]
    assert ids(select.near_target(rows, "teds", 0.5, 3, 0.3, 0.7, {"rows": 6})) == [4, 6, 3]
    assert ids(select.shaped(rows, {"rows": (None, 1)})) == [0, 1] and ids(select.band(rows, "teds", 0.1, 0.3)) == [1, 2]
    one, two = ids(select.sample_by_hash(rows, "sample", 4)), ids(select.sample_by_hash(rows.repartition(3), "sample", 4))
    assert one == two and not set(ids(select.sample_by_hash(rows, "sample", 4, without=rows.where(F.col("sample").isin(one))))) & set(one)
    assert ids(select.filled_up([rows.where("sample = 7"), rows.where("sample > 5")], "sample", 3, [F.asc("sample")])) == [7, 6, 8]
    assert ids(select.problems_first(rows, F.col("rows").isNull(), F.col("sample"), "sample"))[:2] == [5, 9]
    with pytest.raises(ValueError):
        select.require_count(rows, 31)


def test_regions_and_lint(spark):
    regions = spark.createDataFrame([(1, 0, None), (1, 1, 0.2), (1, 2, 0.9)], "sample long, region_idx int, score double")
    assert [(r["region_idx"], r["score"]) for r in select.low_confidence(regions, 2).orderBy("rank").collect()] == [(1, 0.2), (2, 0.9)]
    files = spark.createDataFrame([("a.py", 9, bytearray(b"key = ABC")), ("b.pkl", 1, bytearray(b"x"))], "path string, length long, content binary")
    assert {(r["path"], r["rule"]) for r in select.lint(files, {"secret": "ABC"}, [".pkl"], 5).collect()} == {("a.py", "secret"), ("a.py", "size"), ("b.pkl", "suffix .pkl")}
