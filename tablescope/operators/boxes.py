"""Spatial joins and line operations on boxes of one sample. Tables have sample, idx and box; samples bound every join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as g
from ..functions.text import kernel_column
from ..session import written


#: Boxes of a sample, of both sides, from which on they are dealt out over a grid.
HOT = 1024
#: Boxes to a tile, about.
PER_TILE = 8
#: Boxes of a sample, of both sides, up to which it is matched in one row.
MANY = 64


def pairs(a: DataFrame, b: DataFrame, test: Column | None = None, hot: int = HOT) -> DataFrame:
    """Pairs of a sample's boxes (idx, box) and (other, other_box) that intersect, or meet another test, which implies that they share a point.

    Samples meet by their names. One with more than `hot` boxes is cut into tiles, of which a box goes to all that it reaches; a
    pair counts in the tile of the first corner that both boxes hold. Tiles are as large as the mean box at least, so that a box
    that reaches many tiles meets many boxes too: work grows with the pairs that are found, not with all pairs.
    """
    sides = a.select("sample", "box").union(b.select("sample", "box"))
    grid = _grid(sides, hot)
    left = _tiled(a.select("sample", "idx", "box"), grid)
    right = _tiled(b.select("sample", F.col("idx").alias("other"), F.col("box").alias("other_box")), grid, "other_box").select("sample", "tx", "ty", "other", "other_box")
    x, y = F.greatest("box.x0", "other_box.x0"), F.greatest("box.y0", "other_box.y0")
    here = F.col("x_step").isNull() | ((_tile(x, "x") == F.col("tx")) & (_tile(y, "y") == F.col("ty")))
    met = left.join(right, ["sample", "tx", "ty"]).where(g.intersects(F.col("box"), F.col("other_box")) if test is None else test)
    return met.where(here).select("sample", "idx", "box", "other", "other_box")


def _grid(boxes: DataFrame, hot: int) -> DataFrame:
    """sample, and first corner and size of the tiles of each sample that has more than `hot` boxes."""
    b = F.col("box")
    per = boxes.groupBy("sample").agg(
        F.count("*").alias("n"), F.min(F.least(b["x0"], b["x1"])).alias("x_first"), F.min(F.least(b["y0"], b["y1"])).alias("y_first"), F.max(F.greatest(b["x0"], b["x1"])).alias("x_last"), F.max(F.greatest(b["y0"], b["y1"])).alias("y_last"),
        F.avg(F.abs(b["x1"] - b["x0"])).alias("x_mean"), F.avg(F.abs(b["y1"] - b["y0"])).alias("y_mean"),
    ).where(F.col("n") > hot)
    tiles = F.ceil(F.sqrt(F.col("n") / PER_TILE))
    step = lambda axis: F.greatest((F.col(f"{axis}_last") - F.col(f"{axis}_first")) / tiles, F.col(f"{axis}_mean"), F.lit(1e-9)).alias(f"{axis}_step")
    return per.select("sample", "x_first", "y_first", step("x"), step("y"))


def _tile(value: Column, axis: str) -> Column:
    return F.floor((value - F.col(f"{axis}_first")) / F.col(f"{axis}_step")).cast("int")


def _tiled(rows: DataFrame, grid: DataFrame, box: str = "box") -> DataFrame:
    """Rows once for each tile (tx, ty) that their boxes reach; those of other samples once."""
    reach = lambda axis: F.sequence(_tile(F.least(f"{box}.{axis}0", f"{box}.{axis}1"), axis), _tile(F.greatest(f"{box}.{axis}0", f"{box}.{axis}1"), axis))
    one = F.array(F.lit(0))
    spread = rows.join(grid, "sample", "left")
    for axis in ("x", "y"):
        spread = spread.withColumn(f"t{axis}", F.explode(F.when(F.col("x_step").isNull(), one).otherwise(reach(axis))))
    return spread


def all_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of a sample's boxes, whether they are near or not."""
    return a.select("sample", "idx", "box").join(b.select("sample", F.col("idx").alias("other"), F.col("box").alias("other_box")), "sample")


def best_match(a: DataFrame, b: DataFrame, least: float = 0.1) -> DataFrame:
    """For each box of a the other of the highest IoU of at least `least`, else of the highest IoP, else none; the first of equals."""
    scored = pairs(a, b).select("sample", "idx", "other", g.iou(F.col("box"), F.col("other_box")).alias("iou"), g.iop(F.col("box"), F.col("other_box")).alias("iop"))
    best = lambda c: F.max_by("other", F.struct(c, -F.col("other")))
    found = scored.groupBy("sample", "idx").agg(best("iou").alias("by_iou"), F.max("iou").alias("iou"), best("iop").alias("by_iop"), F.max("iop").alias("iop"))
    mode = F.when(F.col("iou") >= least, "iou").when(F.col("iop") >= least, "iop").otherwise("none")
    out = a.select("sample", "idx").join(found, ["sample", "idx"], "left").withColumn("mode", F.coalesce(mode, F.lit("none")))
    return out.select("sample", "idx", "mode", F.when(F.col("mode") == "iou", F.col("by_iou")).when(F.col("mode") == "iop", F.col("by_iop")).alias("other"), F.when(F.col("mode") == "iou", F.col("iou")).when(F.col("mode") == "iop", F.col("iop")).alias("value"))


def greedy_matches(a: DataFrame, b: DataFrame, least: float = 0.5, many: int = MANY) -> DataFrame:
    """One-to-one pairs of a sample's boxes, from the highest IoU on, ties to higher idx, then other: sample, idx, other.

    Samples of up to `many` boxes, of both sides, are walked from the top in one row. In larger ones, which are never gathered, a
    pair that is the best of both its boxes is taken by that walk whatever else there is, as no two pairs are equal in that order:
    all such pairs are taken at once, pairs of their boxes go, and so on until none is left: as many rounds as the longest chain
    of boxes whose pairs get better and better.
    """
    sides = a.select("sample").union(b.select("sample"))
    large = written(sides.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") > many).select("sample"), "large")
    if large.isEmpty():
        return _walked(_scored(a, b, least))
    only = lambda rows, how: rows.join(large, "sample", how)
    walked = _walked(_scored(only(a, "left_anti"), only(b, "left_anti"), least))
    left = written(_scored(only(a, "left_semi"), only(b, "left_semi"), least), "pairs")
    taken = left.select("sample", "idx", "other").limit(0)
    while not left.isEmpty():
        order = F.struct("iou", "idx", "other")
        best = lambda *side: F.max(order).over(W.partitionBy("sample", *side))
        now = written(left.withColumns({"mine": best("idx"), "yours": best("other")}).where((F.col("mine") == order) & (F.col("yours") == order)).select("sample", "idx", "other"), "taken")
        taken = taken.union(now)
        left = written(left.join(now.select("sample", "idx"), ["sample", "idx"], "left_anti").join(now.select("sample", "other"), ["sample", "other"], "left_anti").select("sample", "idx", "other", "iou"), "pairs")
    return walked.union(taken)


def _scored(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    return pairs(a, b).select("sample", "idx", "other", g.iou(F.col("box"), F.col("other_box")).alias("iou")).where(F.col("iou") >= least)


def _walked(scored: DataFrame) -> DataFrame:
    """Of pairs of small samples those that a walk from the best on takes."""
    kind = {f.name: f.dataType.simpleString() for f in scored.schema}
    none = F.struct(*(F.array().cast(f"array<{kind[c]}>").alias(c) for c in ("idx", "other")))
    free = lambda got, x: ~F.array_contains(got["idx"], x["idx"]) & ~F.array_contains(got["other"], x["other"])
    more = lambda got, x: F.struct(*(F.concat(got[c], F.array(x[c])).alias(c) for c in ("idx", "other")))
    order = F.sort_array(F.collect_list(F.struct("iou", "idx", "other")), asc=False)  # bounded by a small sample's boxes
    lists = scored.groupBy("sample").agg(F.aggregate(order, none, lambda got, x: F.when(free(got, x), more(got, x)).otherwise(got)).alias("got"))
    return lists.select("sample", F.inline(F.arrays_zip(F.col("got.idx").alias("idx"), F.col("got.other").alias("other"))))


def match_rates(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each sample that either side has; two empty sides would agree."""
    n = lambda rows, name: rows.groupBy("sample").agg(F.count("*").alias(name))
    both = n(a, "pred").join(n(b, "true"), "sample", "full").join(n(matches, "matched"), "sample", "left").fillna(0, ["pred", "true", "matched"])
    p, r = F.col("matched") / F.greatest("pred", F.lit(1)), F.col("matched") / F.greatest("true", F.lit(1))
    return both.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def first_box_of_point(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Of points (sample, idx, x, y) the first box, by idx, that holds each, bounds included; null for none."""
    at = points.select("sample", "idx", g.box(F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("box"))
    inside = g.contains_point(F.col("other_box"), F.col("box.x0"), F.col("box.y0"))
    found = pairs(at, boxes, inside).groupBy("sample", "idx").agg(F.min("other").alias("cell"))
    return points.select("sample", "idx").join(found, ["sample", "idx"], "left")


def overlap_flags(boxes: DataFrame, other: DataFrame, least: float = 0.10) -> DataFrame:
    """Boxes that overlap another one by more than `least` of the smaller's area; a box does not meet itself."""
    both = pairs(boxes, other).where(F.col("idx") != F.col("other"))
    share = g.intersection(F.col("box"), F.col("other_box")) / F.least(g.area(F.col("box")), g.area(F.col("other_box")))
    return both.where(share > least).groupBy("sample", "idx").agg(F.count("*").alias("overlaps"))


def union_box(boxes: DataFrame, by: str = "sample") -> DataFrame:
    b = F.col("box")
    wide, high = b["x1"] - b["x0"], b["y1"] - b["y0"]
    share = lambda test: F.count_if(test).cast("double") / F.greatest(F.count("*"), F.lit(1))
    return boxes.groupBy(by).agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"), share(high > 1.5 * wide).alias("vertical_ratio"), share(wide > 1.5 * high).alias("horizontal_ratio"))


def validation(samples: DataFrame, regions: DataFrame, width: int, height: int) -> DataFrame:
    """Totals over regions (sample, box, text): samples without regions, empty texts, invalid and out-of-bounds boxes (by more than a pixel)."""
    b = F.col("box")
    bad = b.isNull() | (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"])
    out = (b["x0"] < -1) | (b["y0"] < -1) | (b["x1"] > width + 1) | (b["y1"] > height + 1)
    per = regions.groupBy("sample").agg(F.count("*").alias("regions"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty_text"), F.count_if(bad).alias("invalid"), F.count_if(~bad & out).alias("out_of_bounds"))
    both = samples.select("sample").distinct().withColumn("__s", F.lit(1)).join(per, "sample", "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return both.agg(F.count("__s").alias("samples"), F.count_if(F.col("regions").isNull()).alias("empty_samples"), F.count_if(F.col("__s").isNull()).alias("extra_samples"), *map(total, ("regions", "empty_text", "invalid", "out_of_bounds")))


def lines_by_gap(boxes: DataFrame, gap: float) -> DataFrame:
    """Boxes with `line`: from top to bottom, a new line begins where a box starts more than `gap` below the end of the one before."""
    order = W.partitionBy("sample").orderBy(F.col("box.y0"), F.col("box.x0"), "idx")
    before = F.lag(F.col("box.y1")).over(order)
    starts = boxes.withColumn("starts", F.when(before.isNull() | (F.col("box.y0") - before > gap), 1).otherwise(0))
    return starts.withColumn("line", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("starts")


def nearest_line(guesses: DataFrame, lines: DataFrame, extent: Column | DataFrame) -> DataFrame:
    """Each guessed position (sample, idx, guess) with the nearest line within max(6, 2.5 % of the extent); a sample's all or none, so that positions ascend by more than 1. The extent is one for all, or a table (sample, extent)."""
    near = guesses.join(lines.select("sample", "line"), "sample", "left").groupBy("sample", "idx", "guess").agg(F.min_by("line", F.struct(F.abs(F.col("line") - F.col("guess")), "line")).alias("line"))
    if isinstance(extent, DataFrame):
        near, extent = near.join(extent, "sample"), F.col("extent")
    reach = F.greatest(F.lit(6.0), extent * 0.025)
    moved = near.withColumn("moved", F.when(F.abs(F.col("line") - F.col("guess")) <= reach, F.col("line")).otherwise(F.col("guess")))
    step = F.col("moved") - F.lag("moved").over(W.partitionBy("sample").orderBy("idx"))
    bad = F.max(F.when(F.col("step") <= 1, 1).otherwise(0)).over(W.partitionBy("sample"))
    return moved.withColumn("step", step).withColumn("bad", bad).select("sample", "idx", "guess", F.when(F.col("bad") == 1, F.col("guess")).otherwise(F.col("moved")).alias("position"))


def interpolated(rows: DataFrame, group: str, order: str, value: str, even: Column | None = None) -> DataFrame:
    """`filled`: missing values on the straight line between the nearest known neighbours; outside them the nearest known one; where nothing is known, `even`; then never falling."""
    w = W.partitionBy(group).orderBy(order)
    back, on = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    known = rows.withColumns({"__v0": F.last(value, True).over(back), "__p0": F.last(at, True).over(back), "__v1": F.first(value, True).over(on), "__p1": F.first(at, True).over(on)})
    share = (F.col(order) - F.col("__p0")).cast("double") / F.nullif(F.col("__p1") - F.col("__p0"), F.lit(0))
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * share
    filled = known.withColumn("filled", F.coalesce(value, line, "__v0", "__v1", *([] if even is None else [even])).cast("double"))
    return filled.withColumn("filled", F.max("filled").over(back)).drop("__v0", "__v1", "__p0", "__p1")


def group_regions(words: DataFrame, gap: float) -> DataFrame:
    """Words' boxes joined line by line: sample, line, box and text, words from left to right."""
    lined = lines_by_gap(words, gap)
    b = F.col("box")
    return lined.groupBy("sample", "line").agg(
        g.box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"])).alias("box"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(b["x0"].alias("x"), "idx", "text"))), lambda s: s["text"]), " ").alias("text")
    )


def running_clusters(values: list[float], tolerance: float) -> list[int]:
    """The cluster of each of some sorted values: the first whose running mean is within the tolerance, else a new one."""
    means: list[float] = []
    sizes: list[int] = []
    out = []
    for v in values:
        k = next((i for i, m in enumerate(means) if abs(v - m) <= tolerance), len(means))
        if k == len(means):
            means.append(v)
            sizes.append(1)
        else:
            sizes[k] += 1
            means[k] += (v - means[k]) / sizes[k]
        out.append(k)
    return out


def cluster_positions(rows: DataFrame, value: str, tolerance: float) -> DataFrame:
    """Rows (sample, idx) with `cluster`; depends on the order within a sample, so a sample's positions are taken together, many samples to a batch."""
    lists = rows.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("value"), "idx"))).alias("p"))  # a sample's boxes
    found = kernel_column(lambda values: running_clusters(list(values), tolerance), F.transform("p", lambda x: x["value"].cast("double")), kind="array<int>")
    placed = lists.select("sample", F.arrays_zip(F.transform("p", lambda x: x["idx"]).alias("idx"), found.alias("cluster")).alias("z"))
    return placed.select("sample", F.inline("z"))


def rotation_candidates(boxes: DataFrame, by: str = "sample", tall: float = 2.0, vertical: float = 0.65) -> DataFrame:
    """Groups whose extent is at least `tall` times as high as wide, or whose boxes are mostly vertical."""
    high, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    return union_box(boxes, by).where((high >= tall * wide) | (F.col("vertical_ratio") >= vertical))


def valid_regions(regions: DataFrame, numbers: str = "bbox") -> DataFrame:
    """Regions with a box of four or eight numbers and a text that is not blank."""
    return regions.where(F.coalesce(F.size(numbers).isin(4, 8), F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def cell_regions(cells: DataFrame, tier: str, source: str = "reconstructed_cells") -> DataFrame:
    """Of cells (sample, quality, cell_idx, text, box) of the samples of one tier, those with text and an area, as regions of score 1."""
    b = F.col("box")
    some = cells.where((F.col("quality") == tier) & (F.coalesce("text", F.lit("")) != "") & b.isNotNull() & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))
    at = F.row_number().over(W.partitionBy("sample").orderBy("cell_idx")) - 1
    return some.select("sample", at.alias("region_idx"), "box", "text", F.lit(1.0).alias("score"), F.lit(1.0).alias("bbox_score"), F.lit(source).alias("source"))


def merged_positions(rows: DataFrame, value: str, gap: float, by: str = "sample") -> DataFrame:
    """Neighbouring positions no more than `gap` apart as one: first, last, and their median and mean."""
    w = W.partitionBy(by).orderBy(value)
    begins = F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)
    runs = rows.select(by, value).withColumn("__b", begins).withColumn("run", F.sum("__b").over(w).cast("int"))
    return runs.groupBy(by, "run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.bround(F.median(value)).cast("long").alias("centre"), (F.sum(value) / F.count(value)).alias("mean"))


def overlap_shares(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of intersecting boxes of a sample with the share of the first box that the other covers; touching edges do not intersect."""
    return pairs(a, b).select("sample", "idx", "other", g.iop(F.col("box"), F.col("other_box")).alias("share"))


def word_regions(words: DataFrame, tolerance: float, gap: float) -> DataFrame:
    """Words (sample, idx, box, text) as lines of neighbouring centres, and lines as regions cut where a word starts more than `gap` right of the one before: sample, line, region, box, text."""
    b = F.col("box")
    lined = words.join(cluster_positions(words.select("sample", "idx", ((b["y0"] + b["y1"]) / 2).alias("y")), "y", tolerance).withColumnRenamed("cluster", "line"), ["sample", "idx"])
    w = W.partitionBy("sample", "line").orderBy(b["x0"], "idx")
    begins = F.when(b["x0"] - F.lag(b["x1"]).over(w) <= gap, 0).otherwise(1)
    cut = lined.withColumn("__b", begins).withColumn("region", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int") - 1)
    return cut.groupBy("sample", "line", "region").agg(
        g.box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"])).alias("box"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(b["x0"].alias("x"), "idx", "text"))), lambda s: s["text"]), " ").alias("text")
    )
