"""Operators over small tables: golden cases, nulls and empty tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tablescope.functions import geometry as g
from tablescope.functions import text as T
from tablescope.operators import boxes, scores, sets, tables
from tablescope.sources import readers, writers
from tablescope.streaming import polls


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_difference_ladder(spark):
    pairs = [("a b", "a  b"), ("a b", "ab"), ("Ab", "ab"), ("a-b", "a.b"), ("O1", "01"), ("", "abc"), ("abc", ""), ("abc", "xyz"), ("...", ""), (None, None)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = [r[0] for r in rows.orderBy("k").select(T.difference_class(F.col("a"), F.col("b"))).collect()]
    assert got == ["whitespace_only", "spacing_only", "case_only", "punctuation_or_symbol_only", "digit_letter_confusion_like", "parseq_empty", "master_empty", "content_changed", "punctuation_or_symbol_only", "same"]


def test_text_expressions(spark):
    assert one(spark, T.squash(F.lit(" a  b\n"))) == "a b"
    assert one(spark, T.normalised_distance(F.lit(None).cast("string"), F.lit(""))) == 0.0
    assert one(spark, T.occurrences(F.lit("aXXbXX"), "XX")) == 2
    assert one(spark, T.ascii_only(F.lit("aéb"), 2)) == "a?"
    assert one(spark, T.file_name_safe(F.lit("/a b/"))) == "a_b"


def test_boxes(spark):
    numbers = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert tuple(one(spark, g.from_numbers(numbers(5, 6, 1, 2)))) == (1, 2, 5, 6)
    assert tuple(one(spark, g.from_numbers(numbers(1, 2, 9, 2, 9, 4, 1, 5)))) == (1, 2, 9, 5)
    assert one(spark, g.from_numbers(numbers(1, 2, 3))) is None
    box = lambda *x: g.box(*(F.lit(v) for v in x))
    assert one(spark, g.iou(box(0, 0, 1, 1), box(0, 0, 20, 1))) == 0.05
    assert one(spark, g.iop(box(0, 0, 1, 1), box(0, 0, 20, 1))) == 1.0
    assert not one(spark, g.intersects(box(0, 0, 1, 1), box(1, 0, 2, 1))) and one(spark, g.touches(box(0, 0, 1, 1), box(1, 0, 2, 1)))
    assert tuple(one(spark, g.unrotate(box(2, 3, 5, 7), F.lit(270), F.lit(10), F.lit(20)))) == (3, 15, 7, 18)
    assert tuple(one(spark, g.page_to_image(box(10, 20, 30, 40), box(0, 0, 100, 100), 2))) == (20, 120, 60, 160)
    assert one(spark, g.to_crop(box(0, 0, 1, 1), box(5, 5, 9, 9))) is None


def table_of(spark, *rows):
    return spark.createDataFrame([(s, i, v) for s, i, v in rows], "sample long, idx int, box struct<x0: int, y0: int, x1: int, y1: int>")


def test_spatial_joins(spark):
    a = table_of(spark, (1, 0, (0, 0, 1, 1)), (1, 1, (50, 50, 60, 60)), (2, 0, (0, 0, 4, 4)))
    b = table_of(spark, (1, 0, (0, 0, 20, 1)), (2, 0, (0, 0, 4, 4)), (2, 1, (0, 0, 4, 4)))
    got = {(r["sample"], r["idx"]): (r["mode"], r["other"]) for r in boxes.best_match(a, b).collect()}
    assert got == {(1, 0): ("iop", 0), (1, 1): ("none", None), (2, 0): ("iou", 0)}
    assert [(r["idx"], r["other"]) for r in boxes.greedy_matches(a.where("sample = 2"), b).collect()] == [(0, 1)]
    rates = {r["sample"]: r["f1"] for r in boxes.match_rates(a, b, boxes.greedy_matches(a, b)).collect()}
    assert rates[1] == 0.0 and abs(rates[2] - 2 / 3) < 1e-12
    assert boxes.best_match(a.limit(0), b).count() == 0 and boxes.greedy_matches(a.limit(0), b).count() == 0


def test_interpolation_and_lines(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([None, 2.0, None, 6.0, None, 5.0])], "sample long, idx int, v double")
    got = [r["filled"] for r in boxes.interpolated(rows, "sample", "idx", "v").orderBy("idx").collect()]
    assert got == [2.0, 2.0, 4.0, 6.0, 6.0, 6.0]
    lines = table_of(spark, (1, 0, (0, 0, 5, 10)), (1, 1, (6, 2, 9, 9)), (1, 2, (0, 30, 5, 40)))
    assert [r["line"] for r in boxes.lines_by_gap(lines, 5).orderBy("idx").collect()] == [1, 1, 2]
    words = lines.withColumn("text", F.concat(F.lit("w"), "idx"))
    assert [r["text"] for r in boxes.group_regions(words, 5).orderBy("line").collect()] == ["w0 w1", "w2"]


def test_shards_and_splits(spark):
    rows = sets.numbered(spark.range(5).withColumnRenamed("id", "k"), ["k"])
    ranges = rows.groupBy(sets.range_shard(F.col("index"), F.col("of"), 3).alias("s")).count().orderBy("s").collect()
    modulo = rows.groupBy(sets.modulo_shard(F.col("index"), 3).alias("s")).count().orderBy("s").collect()
    assert [r["count"] for r in ranges] == [1, 2, 2] and [r["count"] for r in modulo] == [2, 2, 1]
    for n in range(1, 12):
        for k in range(1, n + 1):
            edges = [i * n // k for i in range(k + 1)]
            assert [next(s for s in range(k) if edges[s] <= r < edges[s + 1]) for r in range(n)] == [((r + 1) * k - 1) // n for r in range(n)]
    docs = spark.range(200).select((F.col("id") % 40).alias("d"), "id")
    split = sets.document_split(docs, "d", 0.25).collect()
    assert len(split) == 40 and 50 <= sum(r["n"] for r in split if r["split"] == "validation") <= 55
    assert sets.document_split(docs.limit(0), "d", 0.5).count() == 0


def test_key_checks(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    b = spark.createDataFrame([(2,), (3,)], "k long")
    assert sets.key_audit(a, b, "k").first().asDict() == {"only_left": 1, "only_right": 1, "shared": 1, "repeated_left": 1, "repeated_right": 0}
    with pytest.raises(ValueError, match="repeated"):
        sets.union_disjoint([a.distinct(), b], "k")
    with pytest.raises(ValueError, match="missing"):
        sets.require_all(a, b, "k")
    with pytest.raises(ValueError, match="shards"):
        sets.union_shards(a.withColumn("shard", F.lit(0)), "shard", 2)
    with pytest.raises(ValueError, match="shards"):
        sets.union_shards(a.withColumn("s", F.lit(0)), "s", 2)
    with pytest.raises(ValueError, match="too few"):
        sets.gate(a, F.count("*") > 5, "too few")
    train = spark.createDataFrame([("x", "train"), ("x", "test"), ("y", "train")], "d string, split string")
    assert [tuple(r) for r in sets.leaks(train, "d").collect()] == [("test+train", 1)]
    steps = spark.createDataFrame([("a_9.pt",), ("a_10.pt",), ("b",)], "p string")
    assert sets.latest(steps, "p", "_([0-9]+)").first()["path"] == "a_10.pt"


def test_joins(spark):
    a = spark.createDataFrame([("x", [1, 2, 3])], "k string, v array<int>")
    b = spark.createDataFrame([("x", [7, 8])], "k string, v array<int>")
    assert sets.positional_join(a, b, "k", "v").count() == 2
    left, right = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("x", 9)], "k string, v int")
    assert {tuple(r) for r in sets.merged(left, right, "k").collect()} == {("x", 9), ("y", 2)}
    assert {r["status"] for r in sets.with_status(left, right.drop("v"), "k").collect()} == {"evaluated", "missing_prediction"}


def test_scores(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.25), (3, None, None)], "sample long, teds_s double, teds double")
    got = scores.summary(rows).first()
    assert (got["num_samples"], got["teds"], got["teds_1"]) == (3, 0.625, 1)
    assert scores.summary(rows.limit(0)).first()["teds"] is None
    values = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    assert values.agg(scores.upper_median("v")).first()[0] == 3 and values.agg(scores.exact_median(F.col("v"))).first()[0] == 2.5
    edges = spark.createDataFrame([(v,) for v in (1.0, 0.9, 0.7, 0.5, 0.4999)], "v double")
    assert [r[0] for r in edges.select(scores.bucket(F.col("v"))).collect()] == ["1.00", "0.90-0.99", "0.70-0.89", "0.50-0.69", "<0.50"]
    assert one(spark, scores.error_mode(F.lit(0.6), F.lit(0.95), F.lit(False), F.lit(0), F.lit(9), F.lit(9))) == "text_ocr_error"
    with pytest.raises(ValueError, match="policies"):
        scores.one_policy(spark.createDataFrame([("a",), ("b",)], "policy string"))
    empty = spark.createDataFrame([], "p boolean, t boolean")
    assert scores.confusion(empty, F.col("p"), F.col("t")).first()["precision"] is None


def test_markup_operators(spark):
    true = spark.createDataFrame([(1, "<table><tr><td>a</td></tr></table>"), (2, "<table><tr><td>b</td></tr></table>"), (3, None)], "sample long, markup string")
    pred = true.where("sample = 1")
    got = {r["sample"]: (r["teds"], r["error"]) for r in tables.scored_pairs(pred, true).collect()}
    assert got[1] == (1.0, None) and got[2] == (0.0, "no table") and got[3][0] == 0.0
    assert tables.logical_cells(true).count() == 2
    assert tables.grid_difference(tables.logical_cells(pred), tables.logical_cells(true)).where("mismatches > 0").count() == 1
    tables.register(spark)
    true.createOrReplaceTempView("some_tables")
    assert spark.sql("SELECT sum(table_cells(markup)) FROM some_tables").first()[0] == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"a.png": {"html": "<table></table>", "type": "simple"}, "b.png": {"html": None, "type": "complex"}}))
    assert readers.json_map(spark, f"file://{tmp_path}/map.json").count() == 2
    (tmp_path / "rec.json").write_text(json.dumps({"a.png": [{"bbox": [1, 2, 3, 4], "text": "x", "score": 0.5}, {"bbox": [0, 0, 1, 0, 1, 1, 0, 1], "text": "y"}]}))
    regions = readers.regions(spark, f"file://{tmp_path}/rec.json")
    assert [r["region_idx"] for r in regions.orderBy("region_idx").collect()] == [0, 1]
    (tmp_path / "scores.json").write_text(json.dumps([["a", "<p>", "<p>", 0.5, 0.75, 1.0]]))
    assert readers.positional_scores(spark, f"file://{tmp_path}/scores.json").first().asDict() == {"sample": "a", "pred_html": "<p>", "gt_html": "<p>", "edit_distance": 0.5, "teds_s": 0.75, "teds": 1.0}
    (tmp_path / "w.tsv").write_text("left\ttop\twidth\theight\tconf\ttext\n1\t2\t3\t4\t90\ta\n1\t2\t3\t4\t-1\tb\n1\t2\t3\t4\tx\tc\n1\t2\t3\t4\t50\t \n")
    assert readers.recognised_words(spark, f"file://{tmp_path}/w.tsv").count() == 1
    assert {r["score"] for r in readers.recognised_words(spark, f"file://{tmp_path}/w.tsv", True).collect()} == {0.9, 1.0}
    (tmp_path / "names.txt").write_text("a.png\n\n# note\nb\na.png\n")
    assert readers.name_list(spark, f"file://{tmp_path}/names.txt", comments=True, both_forms=True).count() == 4
    assert readers.optional(spark, f"file://{tmp_path}/none.json", "a int").count() == 0
    found = readers.files(spark, f"file://{tmp_path}", "*.txt", stem="([^/]+)\\.txt$").first()
    assert found["stem"] == "names" and len(found["sha256"]) == 64
    nested = spark.createDataFrame([('{"bbox": [1.0], "tokens": ["a"]}',), ('[{"bbox": [1.0], "tokens": []}, {"x": 1}]',), ("[]",)], "d string")
    assert [len(r[0]) for r in nested.select(readers.boxed_tokens(F.col("d"))).collect()] == [1, 1, 0]
    rows = spark.createDataFrame([("a|b", 0.5, None)], "k string, v double, n int")
    assert "a\\|b | 0.5000 | -" in writers.markdown(rows) and "<td>a|b</td>" in writers.html_table(rows)
    assert json.loads(writers.summary_json(rows))["v"] == 0.5
    writers.manifest(spark.createDataFrame([("b",), ("a",)], "path string"), f"file://{tmp_path}/out")
    assert [r[0] for r in spark.read.csv(f"file://{tmp_path}/out").collect()] == ["a", "b"]


def test_streams(spark, tmp_path):
    seen = [("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("a", 4, 9), ("a", 5, 9), ("b", 1, 9)]
    rows = spark.createDataFrame(seen, "key string, at long, files long")
    batch = polls.stable_runs(rows, "key", "at", "files", 9, 3)
    assert [tuple(r) for r in batch.where("ready").select("key", "at").collect()] == [("a", 4)]
    rows.write.parquet(f"file://{tmp_path}/polls")
    source = spark.readStream.schema("key string, at long, files long").parquet(f"file://{tmp_path}/polls")
    query = polls.stable_stream(source, "key", "at", "files", 9, 3).writeStream.format("memory").queryName("ready_polls").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("ready_polls").collect()] == [("a", 4, 9)]
    assert polls.once(rows, "key").count() == 2
