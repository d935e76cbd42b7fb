"""Operators on groups that hold most rows: tiles, rounds of best pairs, ranks and medians in ranges."""

from __future__ import annotations

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablescope.functions import geometry as g
from tablescope.functions import markup
from tablescope.operators import boxes as b
from tablescope.operators import scores, sets

BOX = "sample long, idx int, box struct<x0: double, y0: double, x1: double, y1: double>"


def some_boxes(rng: random.Random, sample: int, n: int, size: float, extent: float) -> list[tuple]:
    out = []
    for k in range(n):
        x, y = rng.uniform(0, extent), rng.uniform(0, extent)
        w, h = rng.uniform(0, size), rng.uniform(0, size)
        if k % 50 == 0:
            w = extent  # some reach across many tiles
        if rng.random() < 0.3:
            x, y, w, h = round(x), round(y), round(w), round(h)  # edges that touch
        out.append((sample, k, (float(x), float(y), float(x + w), float(y + h))))
    return out


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)
    a = [*some_boxes(rng, 1, 300, 9, 60), *some_boxes(rng, 2, 5, 9, 9), (3, 0, (0.0, 0.0, 5.0, 5.0)), (1, 1000, None), *some_boxes(rng, 5, 200, 0, 4)]
    c = [*some_boxes(rng, 1, 280, 9, 60), *some_boxes(rng, 2, 6, 9, 9), (4, 0, (0.0, 0.0, 5.0, 5.0)), (1, 1000, None), (1, 1001, (9.0, 9.0, 3.0, 3.0)), *some_boxes(rng, 5, 200, 0, 4)]
    return spark.createDataFrame(a, BOX), spark.createDataFrame(c, BOX)


def found(rows) -> list[tuple]:  # noqa: ANN001
    return sorted((r["sample"], r["idx"], r["other"]) for r in rows.collect())


@pytest.mark.parametrize("hot", [0, 100, 1 << 30])
def test_tiles_find_each_pair_once(sides, hot):
    a, c = sides
    every = b.all_pairs(a, c)
    assert found(b.pairs(a, c, hot=hot)) == found(every.where(g.intersects(F.col("box"), F.col("other_box"))))
    touch = g.touches(F.col("box"), F.col("other_box"))
    assert found(b.pairs(a, c, touch, hot)) == found(every.where(touch))


def test_points_find_their_boxes_in_tiles(spark, sides, monkeypatch):
    _, c = sides
    rng = random.Random(2)
    points = spark.createDataFrame([(s, k, float(rng.randint(0, 60)), float(rng.randint(0, 60))) for k in range(200) for s in (1, 2, 9)], "sample long, idx int, x double, y double")
    monkeypatch.setattr(b.pairs, "__defaults__", (None, 1 << 30))
    want = sorted(map(tuple, b.first_box_of_point(points, c).collect()), key=str)
    monkeypatch.setattr(b.pairs, "__defaults__", (None, 10))
    assert sorted(map(tuple, b.first_box_of_point(points, c).collect()), key=str) == want


def test_one_sample_of_20000_boxes(spark):
    """A grid of small boxes against itself moved by a little: 80,000 neighbours of 400,000,000 pairs; no join sees more than a few times that."""
    cell = lambda dx: spark.range(20_000).select(F.lit(1).cast("long").alias("sample"), F.col("id").cast("int").alias("idx"), g.box((F.col("id") % 200) * 10.0 + dx, F.floor(F.col("id") / 200) * 10.0 + dx, (F.col("id") % 200) * 10.0 + 9 + dx, F.floor(F.col("id") / 200) * 10.0 + 9 + dx).alias("box"))
    met = b.pairs(cell(0.0), cell(2.0))
    assert met.count() == 20_000 + 199 * 100 + 200 * 99 + 199 * 99
    left = b._tiled(cell(0.0), b._grid(cell(0.0).select("sample", "box").union(cell(2.0).select("sample", "box")), b.HOT))
    assert left.count() < 4 * 20_000
    assert left.groupBy("tx", "ty").count().agg(F.max("count")).first()[0] < 64
    best = b.best_match(cell(0.0), cell(2.0))
    assert best.where((F.col("mode") == "iou") & (F.col("other") == F.col("idx"))).count() == 20_000


def matches_by_walk(a, c, least: float) -> list[tuple]:  # noqa: ANN001
    pairs = b.all_pairs(a, c).where(g.intersects(F.col("box"), F.col("other_box"))).select("sample", "idx", "other", g.iou(F.col("box"), F.col("other_box")).alias("iou")).collect()
    out = []
    for sample, some in itertools.groupby(sorted(pairs, key=lambda r: r["sample"]), key=lambda r: r["sample"]):
        out += [(sample, p, t) for p, t in markup.greedy_match([(r["iou"], r["idx"], r["other"]) for r in some], least)]
    return sorted(out)


@pytest.mark.parametrize("least", [0.05, 0.5])
def test_best_pairs_are_those_of_the_walk(sides, least):
    a, c = (x.where("box IS NOT NULL") for x in sides)
    assert found(b.greedy_matches(a, c, least)) == matches_by_walk(a, c, least)


def test_ties_go_to_higher_numbers(spark):
    """Equal boxes: all pairs have one value."""
    rows = spark.createDataFrame([(1, k, (0.0, 0.0, 4.0, 4.0)) for k in range(5)], BOX)
    assert found(b.greedy_matches(rows, rows.where("idx < 3"))) == [(1, 2, 0), (1, 3, 1), (1, 4, 2)] == matches_by_walk(rows, rows.where("idx < 3"), 0.5)
    assert b.greedy_matches(rows.limit(0), rows).count() == 0


def test_a_chain_of_better_and_better_pairs(spark):
    """Each box's pair with the next is better than that with the one before: one pair a round."""
    left = spark.createDataFrame([(1, k, (20.0 * k, 0.0, 20.0 * k + 12 + k / 10, 5.0)) for k in range(6)], BOX)
    right = spark.createDataFrame([(1, k, (20.0 * k - 6, 0.0, 20.0 * k + 6 + k / 20, 5.0)) for k in range(6)], BOX)
    assert found(b.greedy_matches(left, right, 0.01)) == matches_by_walk(left, right, 0.01)


def test_ranks_and_medians_of_a_hot_group(spark):
    rng = random.Random(3)
    values = {None: [2.0, 1.0, None], "hot": [rng.choice((0.25, rng.random())) for _ in range(3000)], "one": [5.0], "none": [None], "two": [1.0, 4.0]}
    rows = spark.createDataFrame([(name, v) for name, some in values.items() for v in some], "grp string, v double")
    got = {r["grp"]: (r["middle"], r["upper"]) for r in scores.medians(rows, ["grp"], "v").collect()}
    want = {name: [v for v in some if v is not None] for name, some in values.items()}
    assert got == {name: (statistics.median(some), statistics.median_high(some)) for name, some in want.items() if some}
    assert [tuple(r) for r in scores.medians(rows.limit(0), ["grp"], "v").collect()] == []
    assert scores.medians(rows, [], "v").first()["middle"] == statistics.median([v for some in want.values() for v in some])
    placed = sets.cumulated(rows.where("v IS NOT NULL").withColumn("n", F.lit(2)), ["grp"], [F.desc("v")], F.col("n"))
    for name, some in want.items():
        mine = sorted((r["ahead"], r["of"], r["v"]) for r in placed.where(F.col("grp").eqNullSafe(F.lit(name))).collect())
        if len(set(some)) == len(some):
            assert mine == [(2 * k, 2 * len(some), v) for k, v in enumerate(sorted(some, reverse=True))]


def test_quantile_picks_of_a_hot_group(spark):
    rows = spark.range(4001).select(F.when(F.col("id") < 4000, "hot").otherwise("one").alias("grp"), (F.col("id") * 7 % 4001).alias("v"))
    got = sorted((r["grp"], r["v"]) for r in scores.quantile_picks(rows, "grp", [F.asc("v")]).collect())
    hot = sorted(k * 7 % 4001 for k in range(4000))
    assert got == [*(("hot", hot[k]) for k in (0, 1000, 2000, 3000, 3999)), ("one", 4000 * 7 % 4001)]


def test_small_samples_are_matched_without_rounds(spark, monkeypatch):
    rng = random.Random(8)
    side = lambda: [(s, k, (x := rng.uniform(0, 30)), (y := rng.uniform(0, 30)), x + rng.uniform(5, 20), y + rng.uniform(5, 20)) for s in range(6) for k in range(5 + 10 * (s == 0))]
    rows = lambda some: spark.createDataFrame(some, "sample long, idx int, x0 double, y0 double, x1 double, y1 double").select("sample", "idx", F.struct("x0", "y0", "x1", "y1").alias("box"))
    a, c = rows(side()), rows(side())
    tags = []
    monkeypatch.setattr(b, "written", lambda rows, tag, f=b.written: tags.append(tag) or f(rows, tag))
    want = found(b.greedy_matches(a, c, 0.05))
    assert tags == ["large"] and len(want) > 12
    assert found(b.greedy_matches(a, c, 0.05, 0)) == want == found(b.greedy_matches(a, c, 0.05, 20)) == matches_by_walk(a, c, 0.05)
