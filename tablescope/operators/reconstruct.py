"""Missing cell boxes from the logical grid, as joins and windows over grid lines; diagnostics of the result.

Cells have sample, cell_idx, r0, r1, c0, c1 (half-open) and box, null where it is missing; extents have sample, width and
height. A line table has sample, axis ('x' or 'y'), place and line.

* edges: a line is the median of the box edges that lie on it; outer lines fall back to the extent of all boxes, inner ones
  are interpolated, and no line lies before the one before it.
* centres: a row's or column's centre is the median of its unspanned boxes' centres; lines lie half-way between centres.
* bands: lines as for edges, but a cell of one row takes the band of its row's boxes.

For centres and bands an axis whose values hardly ascend falls back to even spacing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as g

METHODS = ("edges", "centres", "bands")


def _table_boxes(cells: DataFrame, extents: DataFrame) -> DataFrame:
    """sample, rows, columns, width, height and the extent of all boxes, the whole image without any."""
    b = F.col("box")
    per = cells.groupBy("sample").agg(F.max("r1").alias("rows"), F.max("c1").alias("columns"), F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))
    d = lambda c: F.col(c).cast("double")
    return per.join(extents, "sample").select("sample", "rows", "columns", d("width").alias("width"), d("height").alias("height"), F.coalesce(d("x0"), F.lit(0.0)).alias("x0"), F.coalesce(d("y0"), F.lit(0.0)).alias("y0"), F.coalesce(d("x1"), d("width")).alias("x1"), F.coalesce(d("y1"), d("height")).alias("y1"))


def _places(tables: DataFrame, more: int) -> DataFrame:
    """A row for each place of each axis: n + more places, with the extent's start and end."""
    axis = lambda name, n, a, b: F.struct(F.lit(name).alias("axis"), F.col(n).alias("n"), F.col(a).alias("start"), F.col(b).alias("end"))
    both = tables.select("sample", F.inline(F.array(axis("x", "columns", "x0", "x1"), axis("y", "rows", "y0", "y1")))).where(F.col("n") + more > 0)
    return both.select("*", F.explode(F.sequence(F.lit(0), F.col("n") + (more - 1))).alias("place"))


def _medians(cells: DataFrame, parts: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Medians by (sample, axis, place) of (axis, place, value, whether it counts)."""
    rows = F.array(*(F.when(F.col("box").isNotNull() & ok, F.struct(F.lit(a).alias("axis"), p.alias("place"), v.cast("double").alias("value"))) for a, p, v, ok in parts))
    return cells.select("sample", F.inline(F.array_compact(rows))).groupBy("sample", "axis", "place").agg(F.median("value").alias("known"))


def _between(rows: DataFrame) -> DataFrame:
    """`filled`: known values, and those between two known ones on the straight line; others stay null."""
    w = W.partitionBy("sample", "axis").orderBy("place")
    back, on = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("known").isNotNull(), F.col("place"))
    rows = rows.withColumns({"v0": F.last("known", True).over(back), "p0": F.last(at, True).over(back), "v1": F.first("known", True).over(on), "p1": F.first(at, True).over(on)})
    share = (F.col("place") - F.col("p0")) / F.nullif(F.col("p1") - F.col("p0"), F.lit(0))
    return rows.withColumn("filled", F.coalesce("known", F.col("v0") + share * (F.col("v1") - F.col("v0")))).drop("v0", "p0", "v1", "p1")


def _or_even(rows: DataFrame, even: Column, share: float) -> DataFrame:
    """`filled`, or the even spacing for a whole axis one of whose steps is not over a share of the mean step."""
    w = W.partitionBy("sample", "axis").orderBy("place")
    least = F.greatest(F.lit(1e-3), (F.col("end") - F.col("start")) / F.greatest("n", F.lit(1)) * share)
    step = F.col("filled") - F.lag("filled").over(w)
    rows = rows.withColumn("bad", F.when(step <= least, 1).otherwise(0))
    return rows.withColumn("bad", F.max("bad").over(W.partitionBy("sample", "axis"))).withColumn("filled", F.when(F.col("bad") == 1, even).otherwise(F.col("filled"))).drop("bad")


def grid_lines(cells: DataFrame, extents: DataFrame, method: str = "edges") -> DataFrame:
    """sample, axis, place and line."""
    if method not in METHODS:
        raise ValueError(f"no method {method}")
    tables, b = _table_boxes(cells, extents), F.col("box")
    yes = F.lit(True)
    span = (F.col("end") - F.col("start")) / F.greatest("n", F.lit(1))
    if method == "centres":
        x, y = g.centre(b)
        solid = g.area(b) > 0
        known = _medians(cells, [("x", F.col("c0"), x, solid & (F.col("c1") - F.col("c0") == 1)), ("y", F.col("r0"), y, solid & (F.col("r1") - F.col("r0") == 1))])
        even = F.col("start") + (F.col("place") + 0.5) * span
        rows = _places(tables, 0).join(known, ["sample", "axis", "place"], "left")
        rows = rows.withColumn("known", F.when(F.col("known").isNull() & (F.col("place") == 0), even).otherwise(F.col("known")))
        rows = _between(rows).withColumn("filled", F.coalesce("filled", even))
        rows = _or_even(rows, even, 0.05)
        w = W.partitionBy("sample", "axis").orderBy("place")
        rows = rows.withColumn("filled", F.when(F.col("place") == 0, F.col("start")).otherwise((F.lag("filled").over(w) + F.col("filled")) / 2))
        last = rows.where("place = n - 1").withColumn("place", F.col("n")).withColumn("filled", F.col("end"))
        rows = _or_even(rows.unionByName(last), F.col("start") + F.col("place") * span, 0.0)
        return rows.select("sample", "axis", "place", F.col("filled").alias("line"))
    solid = yes if method == "edges" else g.area(b) > 0
    known = _medians(cells, [("x", F.col("c0"), b["x0"], solid), ("x", F.col("c1"), b["x1"], solid), ("y", F.col("r0"), b["y0"], solid), ("y", F.col("r1"), b["y1"], solid)])
    rows = _places(tables, 1).join(known, ["sample", "axis", "place"], "left")
    rows = _between(rows.withColumn("known", F.coalesce("known", F.when(F.col("place") == 0, F.col("start")).when(F.col("place") == F.col("n"), F.col("end")))))
    if method == "edges":
        rows = rows.withColumn("filled", F.max("filled").over(W.partitionBy("sample", "axis").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    else:
        rows = _or_even(rows, F.col("start") + F.col("place") * span, 0.01)
    return rows.select("sample", "axis", "place", F.col("filled").alias("line"))


def with_boxes(cells: DataFrame, extents: DataFrame, method: str = "edges", lines: DataFrame | None = None) -> DataFrame:
    """The cells with all boxes and `reconstructed`; boxes stay within the image. `lines` may come from elsewhere, such as detected ruling lines."""
    lines = grid_lines(cells, extents, method) if lines is None else lines
    tables = _table_boxes(cells, extents).select("sample", "rows", "columns", "width", "height", F.col("x0").alias("tx0"), F.col("y0").alias("ty0"), F.col("x1").alias("tx1"), F.col("y1").alias("ty1"))
    per = lines.groupBy("sample").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("axis") == a, F.struct("place", "line")))).alias(a) for a in "xy"))  # a table's lines
    rows = cells.join(tables, "sample").join(per, "sample", "left")
    x0, x1, y0, y1 = F.col("x")[F.col("c0")], F.col("x")[F.col("c1")], F.col("y")[F.col("r0")], F.col("y")[F.col("r1")]
    if method == "bands":
        b = F.col("box")
        one = F.col("r1") - F.col("r0") == 1
        solid = F.when(one & (g.area(b) > 0), b)
        w = W.partitionBy("sample", "r0")
        rows = rows.withColumn("top", F.min(solid["y0"]).over(w)).withColumn("bottom", F.max(solid["y1"]).over(w))
        inside = one & F.col("top").isNotNull()
        y0, y1 = F.when(inside, F.col("top").cast("double")).otherwise(y0), F.when(inside, F.col("bottom").cast("double")).otherwise(y1)
        wide, high = F.greatest(F.lit(1.0), (F.col("tx1") - F.col("tx0")) / F.greatest("columns", F.lit(1))), F.greatest(F.lit(1.0), (F.col("ty1") - F.col("ty0")) / F.greatest("rows", F.lit(1)))
        x1, y1 = F.when(x1 <= x0, F.least(F.col("width"), x0 + wide)).otherwise(x1), F.when(y1 <= y0, F.least(F.col("height"), y0 + high)).otherwise(y1)
    side = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.col(most))
    made = g.box(side(x0, "width"), side(y0, "height"), side(x1, "width"), side(y1, "height"))
    own = F.col("box")
    kept = g.box(*(own[c].cast("double") for c in ("x0", "y0", "x1", "y1")))
    return rows.select(*[c for c in cells.columns if c != "box"], F.when(own.isNotNull(), kept).otherwise(made).alias("box"), own.isNull().alias("reconstructed"))


def diagnostics(cells: DataFrame, extents: DataFrame, huge: float = 8.0, overlap: float = 0.10) -> DataFrame:
    """By sample: reconstructed, invalid, outside, huge and overlapping boxes, and the causes joined with ';'."""
    b, made = F.col("box"), F.col("reconstructed")
    rows = cells.join(extents, "sample")
    bad = (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"])
    out = (b["x0"] < 0) | (b["y0"] < 0) | (b["x1"] > F.col("width")) | (b["y1"] > F.col("height"))
    typical = F.median(F.when(~made & (g.area(b) > 0), g.area(b))).over(W.partitionBy("sample"))
    rows = rows.withColumn("typical", typical)
    per = rows.groupBy("sample").agg(F.count("*").alias("cells"), F.count_if(made).alias("reconstructed"), F.count_if(made & bad).alias("invalid"), F.count_if(made & ~bad & out).alias("out_of_image"), F.count_if(made & (g.area(b) > huge * F.col("typical"))).alias("huge"))
    other = cells.select("sample", *(F.col(c).alias(f"o_{c}") for c in ("cell_idx", "r0", "r1", "c0", "c1")), F.col("box").alias("other_box"))
    apart = (F.col("r1") <= F.col("o_r0")) | (F.col("o_r1") <= F.col("r0")) | (F.col("c1") <= F.col("o_c0")) | (F.col("o_c1") <= F.col("c0"))
    pairs = cells.where(made).join(other, "sample").where((F.col("cell_idx") != F.col("o_cell_idx")) & apart & g.intersects(b, F.col("other_box")))
    over = pairs.where(g.intersection(b, F.col("other_box")) / F.least(g.area(b), g.area(F.col("other_box"))) > overlap).groupBy("sample").agg(F.count("*").alias("overlaps"))
    joined = per.join(over, "sample", "left").fillna(0, ["overlaps"])
    n = F.col
    causes = F.array_compact(F.array(
        F.when(n("invalid") > 0, "invalid_zero_area"), F.when(n("overlaps") > 0, "overlap_from_tight_text_boundaries"), F.when(n("huge") > 0, "oversized_interpolated_cells"),
        F.when((n("invalid") + n("overlaps") + n("huge") == 0) & (n("reconstructed") > 0), "reconstructed_without_detected_geometry_issue"), F.when(n("reconstructed") == 0, "no_reconstruction_needed"),
    ))
    return joined.withColumn("causes", F.array_join(causes, ";"))


def boxed_words(text: Column, b: Column) -> Column:
    """Array of struct(word_idx, word, box), a word of the text each: left to right in the box, as wide as the word is long. A row is all that is needed: no window over its words."""
    words = F.split(F.trim(text), "\\s+")
    sums = F.aggregate(words, F.array(F.lit(0.0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w).cast("double"))))
    wide = F.greatest(F.lit(1.0), (b["x1"] - b["x0"]).cast("double"))

    def placed(words: Column, sums: Column, last: Column) -> Column:
        total = F.greatest(F.element_at(sums, -1), F.lit(1.0))  # no letters, no word

        def one(word: Column, k: Column) -> Column:
            a = b["x0"] + wide * F.get(sums, k) / total
            z = F.when(k == last, b["x1"].cast("double")).otherwise(b["x0"] + wide * F.get(sums, k + 1) / total)
            return F.struct(k.alias("word_idx"), word.alias("word"), g.box(a, b["y0"].cast("double"), F.greatest(a, z), b["y1"].cast("double")).alias("box"))

        return F.filter(F.transform(words, one), lambda x: x["word"] != "")

    # words, sums and the last word's place are bound once for all words
    last = F.array_max(F.transform(words, lambda w, k: F.when(w != "", k)))
    return F.get(F.transform(F.array(F.struct(words.alias("w"), sums.alias("s"), last.alias("z"))), lambda t: placed(t["w"], t["s"], t["z"])), F.lit(0))


def word_boxes(rows: DataFrame) -> DataFrame:
    """A box for each word of `text`, left to right in the row's box, as wide as the word is long."""
    return rows.select("sample", "idx", F.inline(boxed_words(F.col("text"), F.col("box")))).select("sample", "idx", "word_idx", "word", "box")


def scaled(b: Column, scale: float, page_width: Column, page_height: Column, bounds: Column | None = None, origin_y: Column | None = None) -> Column:
    """(box, mode): page coordinates to image pixels, flipped if that makes a box of over a pixel, else unflipped; clamped to the bounds first, then as it is; else `invalid`."""
    origin_y = F.lit(0.0) if origin_y is None else origin_y
    wide, high = page_width * scale, page_height * scale
    side = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    clip = lambda x: g.box(side(x["x0"], wide), side(x["y0"], high), side(x["x1"], wide), side(x["y1"], high))

    def both(raw: Column, name: str) -> list[tuple[Column, str]]:
        flip = clip(g.box(raw["x0"] * scale, (page_height - (raw["y1"] - origin_y)) * scale, raw["x1"] * scale, (page_height - (raw["y0"] - origin_y)) * scale))
        same = clip(g.box(raw["x0"] * scale, (raw["y0"] - origin_y) * scale, raw["x1"] * scale, (raw["y1"] - origin_y) * scale))
        return [(flip, f"{name}_flip"), (same, f"{name}_noflip")]

    tries = []
    if bounds is not None:
        held = lambda v, a, z: F.least(F.greatest(v, a), z)
        tries += both(g.box(held(b["x0"], bounds["x0"], bounds["x1"]), held(b["y0"], bounds["y0"], bounds["y1"]), held(b["x1"], bounds["x0"], bounds["x1"]), held(b["y1"], bounds["y0"], bounds["y1"])), "clamp")
    raw = both(b, "raw")
    tries += raw
    good = lambda x: (x["x1"] - x["x0"] > 1) & (x["y1"] - x["y0"] > 1)
    return F.coalesce(*(F.when(good(x), F.struct(x.alias("box"), F.lit(mode).alias("mode"))) for x, mode in tries), F.struct(raw[0][0].alias("box"), F.lit("invalid").alias("mode")))


def snapped_lines(cells: DataFrame, extents: DataFrame, ruled: DataFrame) -> DataFrame:
    """The lines of the `centres` method, moved to detected ruling lines (sample, axis, line): an axis's inner lines all or none, outer ones never."""
    from .boxes import nearest_line

    lines = grid_lines(cells, extents, "centres")
    w = W.partitionBy("sample", "axis")
    ends = lines.withColumn("low", F.min("line").over(w)).withColumn("high", F.max("line").over(w)).withColumn("last", F.max("place").over(w))
    inner = ends.where((F.col("place") > 0) & (F.col("place") < F.col("last")))
    axis = F.struct("sample", "axis").alias("sample")
    guesses = inner.select(axis, F.col("place").alias("idx"), F.col("line").alias("guess"), (F.col("high") - F.col("low")).alias("extent"))
    moved = nearest_line(guesses.drop("extent"), ruled.select(axis, "line"), guesses.select("sample", "extent").distinct())
    moved = moved.select("sample.sample", "sample.axis", F.col("idx").alias("place"), F.col("position").alias("moved"))
    return lines.join(moved, ["sample", "axis", "place"], "left").select("sample", "axis", "place", F.coalesce("moved", "line").alias("line"))


def reconstruction_counts(cells: DataFrame) -> DataFrame:
    """By sample, of cells with boxes and their texts: rows and columns of the occupied grid, cells, and reconstructed boxes, those of cells without visible text apart."""
    empty = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]+>", "")) == ""
    made = F.col("reconstructed")
    return cells.groupBy("sample").agg(F.max("r1").alias("num_rows"), F.max("c1").alias("num_cols"), F.count("*").alias("total_cells"), F.count_if(made).alias("reconstructed_bboxes"), F.count_if(made & empty).alias("reconstructed_empty_bboxes"))
