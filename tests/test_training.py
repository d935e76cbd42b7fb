from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablescope.functions import structure as S
from tablescope.functions.markup import logical_cells
from tablescope.operators import training as T

ROW = ["<tr>", "<td>", "</td>", "</tr>"]


def test_sections():
    assert S.sectioned(["<table>", *ROW, "</table>"]) == ["<thead>", "</thead>", "<tbody>", *ROW, "</tbody>"]
    assert S.sectioned([*ROW, *ROW], True) == ["<thead>", *ROW, "</thead>", "<tbody>", *ROW, "</tbody>"]
    assert S.sectioned(["<thead>", "</thead>", *ROW]) == ["<thead>", "</thead>", *ROW]
    nested = ["<tr>", "<td>", *ROW, "</td>", "</tr>", "<tr>"]
    assert [nested[r] for r in S.top_rows(nested)] == [["<tr>", "<td>", *ROW, "</td>", "</tr>"]]


def test_placed_text():
    tokens = ["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td>", "</td>", "</tr>", "<tr>", "<td>", "</td>", "</tr>"]
    assert S.placed_text(tokens, {(0, 0): "a", (1, 1): "c"}) == '<table><tr><td rowspan="2">a</td><td></td></tr><tr><td>c</td></tr></table>'
    assert S.placed_text([], {}) == ""


def test_otsl_markup():
    assert S.otsl_markup("fcel lcel nl fcel ecel nl".split(), ["a", "b", ""]) == '<tr><td colspan="2">a</td></tr><tr><td>b</td><td></td></tr>'
    for texts in (["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            S.otsl_markup(["fcel", "fcel", "nl"], texts)


def test_types_and_texts():
    plain = "<table><thead><tr><td>a</td></tr></thead></table>"
    assert (S.type_by_sections(plain), S.type_by_spans(plain)) == ("complex", "simple")
    assert S.type_by_spans('<table><tr><td colspan="x">') == "complex" and S.type_by_spans(None) == "simple"
    assert S.cell_texts("<table><tr><td> a </td><td></td></tr></table>") == ["a"]
    assert S.first_difference(plain, plain) is None and S.first_difference(plain, None) == (0, "a", None)
    assert S.display_grid(logical_cells("<table><tr><td colspan=2>a</td></tr></table>")) == [["a", "↳"]]


def test_entries(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    mapped = spark.createDataFrame([(1, 7, "ab cd", 3, (0.0, 0.0, 1.0, 1.0)), (1, 7, "ab cd", 2, (5.0, 0.0, 6.0, 1.0)), (1, 8, "x", 1, (9.0, 9.0, 10.0, 10.0))], f"sample long, cell_idx int, text string, region_idx int, box {box}")
    entries = T.coordinate_groups(mapped)
    assert [entries.first()["dr_coord"][k]["cell_idx"] for k in (0, 1)] == [8, 7]
    got = T.regions_of_groups(entries).orderBy("region_idx").collect()
    assert [(r["text"], r["box"]["x0"]) for r in got] == [("x", 9), ("ab cd", 5), ("", 0)]
    lines = mapped.select(T.gold_coordinate(F.col("text"), F.col("box"))).collect()
    assert lines[2][0] == "9.00 9.00 10.00 10.00 2 x" and T.coordinate_groups(mapped.limit(0)).count() == 0


def test_inventory(spark):
    rows = spark.createDataFrame([("d1", "h", (1, 1, 1, 1, 1)), ("d2", None, (1, 1, 1, 1, 1)), ("d3", "h", (1, 1, 1, 1, None)), ("t", "h", (1, 1, 1, 1, 1)), ("d4", "h", None)], "doc string, html string, coord struct<left: int, top: int, right: int, bottom: int, page_no: int>")
    test = spark.createDataFrame([("t",)], "doc string")
    split = spark.createDataFrame([("d1", "validation"), ("d2", "train"), ("t", "train")], "doc string, split string")
    found = T.assigned(T.inventory(rows, {"html": F.col("html").isNotNull()}, "coord", "doc", test), split, "doc")
    assert {r["doc"]: r["split"] for r in found.collect()} == {"d1": "validation", "d2": "invalid", "d3": "invalid", "t": "test_overlap", "d4": "invalid"}
    assert {r["doc"]: r["missing"] for r in found.collect()}["d2"] == ["html"]
