"""Inventories, splits and training entries as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .scores import first_reason

COORDINATES = ("left", "top", "right", "bottom", "page_no")


def inventory(rows: DataFrame, required: Mapping[str, Column], coordinates: str, document: str, fixed_test: DataFrame) -> DataFrame:
    """Rows with `missing` (names of required things that are not there), `coord_valid`, `overlaps_fixed_test` and `valid_for_split`."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(~there, F.lit(True)), name) for name, there in required.items())))
    ok = F.coalesce(F.forall(F.array(*(F.col(f"{coordinates}.{c}").isNotNull() for c in COORDINATES)), lambda x: x), F.lit(False))
    test = fixed_test.select(document).distinct().withColumn("__test", F.lit(True))
    out = rows.withColumn("missing", missing).withColumn("coord_valid", ok).join(test, document, "left").withColumn("overlaps_fixed_test", F.coalesce("__test", F.lit(False))).drop("__test")
    return out.withColumn("valid_for_split", (F.size("missing") == 0) & F.col("coord_valid"))


def assigned(rows: DataFrame, split: DataFrame, document: str) -> DataFrame:
    """`split` of each row: test_overlap, invalid, or that of its document; documents without one are invalid."""
    joined = rows.join(split.select(document, F.col("split").alias("__split")), document, "left")
    return joined.withColumn("split", first_reason((F.col("overlaps_fixed_test"), "test_overlap"), (~F.col("valid_for_split"), "invalid"), (F.col("__split") == "validation", "validation"), (F.col("__split") == "train", "train"), otherwise="invalid")).drop("__split")


def gold_coordinate(text: Column, b: Column) -> Column:
    """A cell's box and text as a training line, or the line for nothing."""
    have = b.isNotNull() & (F.coalesce(text, F.lit("")) != "")
    return F.when(have, F.format_string("%.2f %.2f %.2f %.2f 2 %s", *(b[c].cast("double") for c in ("x0", "y0", "x1", "y1")), text)).otherwise("-1.0 -1.0 -1.0 -1.0 1 ")


def coordinate_groups(mapped: DataFrame) -> DataFrame:
    """Of mapped regions (sample, cell_idx, text, region_idx, box) a map by sample: group number to (boxes, cell_idx, text), groups in the order of their first region."""
    cells = mapped.groupBy("sample", "cell_idx", "text").agg(F.min("region_idx").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("region_idx", "box"))), lambda r: r["box"]).alias("boxes"))
    lists = cells.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("first", "cell_idx", "boxes", "text"))).alias("g"))  # a sample's cells
    entries = F.transform("g", lambda x, k: F.struct(k.alias("key"), F.struct(x["boxes"].alias("boxes"), x["cell_idx"].alias("cell_idx"), x["text"].alias("text")).alias("value")))
    return lists.select("sample", F.map_from_entries(entries).alias("dr_coord"))


def regions_of_groups(entries: DataFrame) -> DataFrame:
    """Regions (sample, region_idx, box, text, score) of coordinate groups: a group's text stands at its first box alone."""
    groups = entries.select("sample", F.explode("dr_coord").alias("group_idx", "e")).select("sample", "group_idx", F.posexplode("e.boxes").alias("box_idx", "box"), F.col("e.text").alias("t"))
    lists = groups.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("group_idx", "box_idx", "box", F.when(F.col("box_idx") == 0, F.col("t")).otherwise("").alias("text")))).alias("r"))
    return lists.select("sample", F.posexplode("r").alias("region_idx", "r")).select("sample", "region_idx", "r.box", "r.text", F.lit(1.0).alias("score"))


def padded_page_box(b: Column, crop: Column, page: Column, scale: float, padding: float) -> Column:
    """A box of the crop's pixels on the page, grown by the padding and kept on the page."""
    side = lambda v, a, z: F.least(F.greatest(v, a), z)
    x = lambda c, d: side(crop["x0"] + b[c] / scale + d, page["x0"], page["x1"])
    y = lambda c, d: side(crop["y0"] + b[c] / scale + d, page["y0"], page["y1"])
    return g.box(x("x0", -padding), y("y0", -padding), x("x1", padding), y("y1", padding))


def page_fit(crop_width: Column, crop_height: Column, image_width: Column, image_height: Column) -> Column:
    """(x, y) ratios of an image's size to its crop's, to three places, ties to even."""
    return F.struct(F.bround(image_width / F.nullif(crop_width, F.lit(0)), 3).alias("x"), F.bround(image_height / F.nullif(crop_height, F.lit(0)), 3).alias("y"))
