"""Boxes as structs (x0, y0, x1, y1), half-open, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def from_numbers(numbers: Column, as_is: bool = False, strict: bool = False) -> Column:
    """The bounding box of four numbers, corners in any order, or of a polygon of eight; null for any other length, or, `strict`, an error. `as_is` takes four numbers as the corners that they are said to be."""
    xs = F.filter(numbers, lambda _, i: i % 2 == 0)
    ys = F.filter(numbers, lambda _, i: i % 2 == 1)
    around = box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    given = box(*(F.get(numbers, F.lit(k)) for k in range(4))) if as_is else around
    found = F.when(F.size(numbers) == 4, given).when(F.size(numbers) == 8, around)
    return found.when(numbers.isNotNull(), F.raise_error(F.lit("a box has four or eight numbers"))) if strict else found


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0)) * F.greatest(b["y1"] - b["y0"], F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both.cast("double") / union).otherwise(F.lit(0.0))


def iop(pred: Column, other: Column) -> Column:
    """Intersection over the first box."""
    return F.when(area(pred) > 0, intersection(pred, other).cast("double") / area(pred)).otherwise(F.lit(0.0))


def intersects(a: Column, b: Column) -> Column:
    """Strict: touching edges do not intersect."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def touches(a: Column, b: Column) -> Column:
    """Closed bounds: touching edges count."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def page_to_image(b: Column, page: Column, scale: float) -> Column:
    """Bottom-left page coordinates to top-left image pixels, not below 0, cut to whole numbers."""
    whole = lambda c: F.greatest(c, F.lit(0)).cast("int")
    return box(whole((b["x0"] - page["x0"]) * scale), whole((page["y1"] - b["y1"]) * scale), whole((b["x1"] - page["x0"]) * scale), whole((page["y1"] - b["y0"]) * scale))


def to_crop(b: Column, crop: Column) -> Column:
    """Relative to the crop, clamped to it; null where less than a pixel is left."""
    wide, high = crop["x1"] - crop["x0"], crop["y1"] - crop["y0"]
    side = lambda v, most: F.least(F.greatest(v, F.lit(0)), most)
    out = box(side(b["x0"] - crop["x0"], wide), side(b["y0"] - crop["y0"], high), side(b["x1"] - crop["x0"], wide), side(b["y1"] - crop["y0"], high))
    return F.when((out["x1"] - out["x0"] >= 1) & (out["y1"] - out["y0"] >= 1), out)


def unrotate(b: Column, rotation: Column, width: Column, height: Column) -> Column:
    """A box found on an image turned by 0, 90 or 270 degrees, in the original's width and height."""
    turned = (
        F.when(rotation == 90, box(width - b["y1"], b["x0"], width - b["y0"], b["x1"]))
        .when(rotation == 270, box(b["y0"], height - b["x1"], b["y1"], height - b["x0"]))
        .otherwise(box(b["x0"], b["y0"], b["x1"], b["y1"]))
    )
    side = lambda v, most: F.least(F.greatest(v, F.lit(0)), most)
    return box(side(turned["x0"], width), side(turned["y0"], height), side(turned["x1"], width), side(turned["y1"], height))
