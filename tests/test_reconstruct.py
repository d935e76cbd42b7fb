"""Missing boxes from the grid: the three methods on small tables, diagnostics, word boxes and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions import geometry as g
from tablescope.operators import reconstruct as R

CELLS = "sample long, cell_idx int, r0 int, r1 int, c0 int, c1 int, box struct<x0: double, y0: double, x1: double, y1: double>"


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), CELLS)


def extents(spark):
    return spark.createDataFrame([(k, 100, 100) for k in (1, 2)], "sample long, width int, height int")


def lines(rows, axis):
    return [r["line"] for r in sorted(rows, key=lambda r: r["place"]) if r["axis"] == axis]


def test_edges(spark):
    rows = cells(spark, (1, 0, 0, 1, 0, 1, (10.0, 10.0, 30.0, 20.0)), (1, 1, 0, 1, 1, 2, None), (1, 2, 0, 1, 2, 3, (60.0, 12.0, 90.0, 22.0)), (2, 0, 0, 1, 0, 2, None))
    got = R.grid_lines(rows, extents(spark)).collect()
    one, two = [r for r in got if r["sample"] == 1], [r for r in got if r["sample"] == 2]
    assert lines(one, "x") == [10, 30, 60, 90] and lines(one, "y") == [11, 21] and lines(two, "x") == [0, 50, 100]
    full = R.with_boxes(rows, extents(spark))
    made = full.where("reconstructed AND sample = 1").first()["box"]
    assert tuple(made) == (30, 11, 60, 21)
    report = {r["sample"]: r for r in R.diagnostics(full, extents(spark)).collect()}
    assert report[1]["causes"] == "reconstructed_without_detected_geometry_issue" and report[1]["reconstructed"] == 1


def test_centres_fall_back_to_even_spacing(spark):
    rows = cells(spark, (1, 0, 0, 1, 0, 1, (0.0, 0.0, 10.0, 10.0)), (1, 1, 0, 1, 1, 2, None), (1, 2, 0, 1, 2, 3, (80.0, 0.0, 100.0, 10.0)), (2, 0, 0, 1, 0, 1, (40.0, 0.0, 60.0, 10.0)), (2, 1, 0, 1, 1, 2, (40.0, 0.0, 60.0, 10.0)))
    got = R.grid_lines(rows, extents(spark), "centres").collect()
    assert lines([r for r in got if r["sample"] == 1], "x") == [0, 26.25, 68.75, 100]  # centres 5, 47.5, 90
    assert lines([r for r in got if r["sample"] == 2], "x") == [40, 50, 60]


def test_bands(spark):
    rows = cells(spark, (1, 0, 0, 1, 0, 1, (0.0, 5.0, 40.0, 15.0)), (1, 1, 0, 1, 1, 2, None), (1, 2, 1, 2, 0, 1, (0.0, 50.0, 40.0, 60.0)), (1, 3, 1, 2, 1, 2, (50.0, 45.0, 90.0, 62.0)))
    made = R.with_boxes(rows, extents(spark), "bands").where("reconstructed").first()["box"]
    assert (made["y0"], made["y1"]) == (5, 15) and made["x1"] == 90


def test_nothing(spark):
    none = cells(spark)
    assert R.grid_lines(none, extents(spark)).count() == 0 and R.with_boxes(none, extents(spark), "bands").count() == 0 and R.diagnostics(R.with_boxes(none, extents(spark)), extents(spark)).count() == 0


def test_word_boxes(spark):
    rows = spark.createDataFrame([(1, 0, (0.0, 0.0, 30.0, 5.0), "ab c"), (1, 1, (0.0, 0.0, 3.0, 5.0), " ")], "sample long, idx int, box struct<x0: double, y0: double, x1: double, y1: double>, text string")
    assert [(r["word"], r["box"]["x0"], r["box"]["x1"]) for r in R.word_boxes(rows).orderBy("word_idx").collect()] == [("ab", 0, 20), ("c", 20, 30)]


def test_word_boxes_of_odd_blanks(spark):
    """Empty pieces at either end keep their places, as they had in a window over a row's words."""
    rows = spark.createDataFrame([(1, 0, (0.0, 0.0, 60.0, 5.0), "\tab  c\n"), (1, 1, (0.0, 0.0, 30.0, 5.0), None), (1, 2, (0.0, 0.0, 0.5, 5.0), "ab c")], "sample long, idx int, box struct<x0: double, y0: double, x1: double, y1: double>, text string")
    got = [(r["idx"], r["word_idx"], r["word"], r["box"]["x0"], r["box"]["x1"]) for r in R.word_boxes(rows).orderBy("idx", "word_idx").collect()]
    assert got == [(0, 1, "ab", 0, 40), (0, 2, "c", 40, 60), (2, 0, "ab", 0, 2 / 3), (2, 1, "c", 2 / 3, 2 / 3)]


def test_words_are_numbered_by_their_cells(spark):
    """One shuffle by table, for cells; none for words."""
    from tablescope.operators import tables

    rows = spark.createDataFrame([(1, 1, "a <b>bb</b> c", (0.0, 0.0, 9.0, 1.0)), (1, 0, "x y", (0.0, 0.0, 9.0, 1.0)), (1, 2, " ", (0.0, 0.0, 9.0, 1.0)), (2, 0, "z", (0.0, 0.0, 9.0, 1.0))], "sample long, cell_idx int, text string, box struct<x0: double, y0: double, x1: double, y1: double>")
    found = tables.recognised_tokens(rows, words=True)
    assert [tuple(r) for r in found.select("sample", "id", "text", "line", "index_in_line").orderBy("sample", "id").collect()] == [(1, 1, "x", 0, 0), (1, 2, "y", 0, 1), (1, 3, "a", 1, 0), (1, 4, "<b>bb</b>", 1, 1), (1, 5, "c", 1, 2), (2, 1, "z", 0, 0)]
    assert tables.recognised_tokens(rows, words=True)._jdf.queryExecution().sparkPlan().toString().count("Window ") == 1


def test_scaling_modes(spark):
    box = lambda *x: g.box(*(F.lit(float(v)) for v in x))
    mode = lambda b, **k: spark.range(1).select(R.scaled(b, 2.0, F.lit(100.0), F.lit(100.0), **k).alias("s")).first()["s"]
    got = mode(box(10, 20, 30, 40))
    assert (got["mode"], tuple(got["box"])) == ("raw_flip", (20, 120, 60, 160))
    assert mode(box(10, 20, 30, 40), bounds=box(0, 0, 100, 100))["mode"] == "clamp_flip"
    assert mode(box(10, 150, 30, 190))["mode"] == "invalid"
    assert mode(box(10, 101, 30, 199), origin_y=F.lit(100.0))["mode"] == "raw_flip"
