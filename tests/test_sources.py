"""JSON documents by splits, table functions, tracks, small files, and the session's helpers."""

from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescope import session
from tablescope.functions import diffs, markup
from tablescope.operators import table_functions, tracks
from tablescope.sources import json_members, readers, writers


def texts(rng: random.Random, n: int) -> dict[str, object]:
    """Members whose keys and texts hold quotes, backslashes, commas and brackets, and whose values nest."""
    word = lambda: "".join(rng.choice('ab"\\,{}[]: \né中') for _ in range(rng.randint(0, 30)))
    value = lambda d: word() if d > 2 or rng.random() < 0.4 else [value(d + 1) for _ in range(rng.randint(0, 4))] if rng.random() < 0.5 else {word(): value(d + 1) for _ in range(rng.randint(0, 3))}
    return {f"{k}:{word()}": {"html": word() * rng.randint(1, 20), "type": rng.choice(["x,", None]), "more": value(0)} for k in range(n)}


@pytest.mark.parametrize("split", [37, 400, 5000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_members_whatever_the_splits(spark, tmp_path, split, indent):
    """Splits that begin in strings, in escapes, deep inside of members, and members over many splits."""
    rng = random.Random(split)
    objects = [texts(rng, n) for n in ((2, 0, 1) if split < 100 else (25, 0, 1, 12))]
    for k, some in enumerate(objects):
        (tmp_path / f"o{k}.json").write_text(("\ufeff" if k == 2 else "") + json.dumps(some, ensure_ascii=k % 2 == 0, indent=indent), encoding="utf-8")
        (tmp_path / f"a{k}.txt").write_text(json.dumps(list(some.values()), indent=indent, ensure_ascii=False), encoding="utf-8")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found = json_members.pieces(spark, f"file://{tmp_path}/o*.json")
        got = sorted((r["sample"], r["html"], r["type"]) for r in readers.json_map(spark, f"file://{tmp_path}/o*.json").collect())
        assert got == sorted((k, v["html"], v["type"]) for some in objects for k, v in some.items())
        parts = found.select("file", "block").distinct().count()
        assert parts > (10 if split < 500 else 1)
        got = sorted(r["html"] for r in readers.json_array(spark, f"file://{tmp_path}/a*.txt", "html string, type string").collect())
        assert got == sorted(v["html"] for some in objects for v in some.values())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    with (tmp_path / "large.json").open("w") as out:
        out.write("{")
        out.write(",".join(f'"k{i}": {{"html": "{"x, y" * 50}", "type": "{i % 7}"}}' for i in range(100_000)))
        out.write("}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
        rows = readers.json_map(spark, f"file://{tmp_path}/large.json")
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 8
        assert rows.agg(F.count("*"), F.count_distinct("sample"), F.sum(F.length("html"))).first() == (100_000, 100_000, 20_000_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_what_is_no_document_is_an_error(spark, tmp_path):
    (tmp_path / "array.json").write_text("[1, 2]")
    (tmp_path / "broken.json").write_text('{"a": {"html": "x"}, "b": {"html": tru')
    for name in ("array.json", "broken.json"):
        with pytest.raises(Exception, match="begins with|MALFORMED|FAILFAST"):
            readers.json_map(spark, f"file://{tmp_path}/{name}").collect()


def test_written_documents_are_read_back(spark, tmp_path):
    rows = spark.range(300).select(F.col("id"), F.to_json(F.struct(F.concat(F.lit('a,"'), F.col("id").cast("string")).alias("v"))).alias("member"), (F.col("id") % 3).alias("document"))
    writers.json_documents(rows, f"file://{tmp_path}/docs", "[]", "member", "id")
    assert sorted(r["v"] for r in readers.json_array(spark, f"file://{tmp_path}/docs/*", "v string").collect()) == sorted(f'a,"{k}' for k in range(300))


def test_a_document_is_one_file_whatever_its_size(spark, tmp_path):
    """Shuffles of several megabytes, whose parts are joined unlike those of a row for each document."""
    rows = spark.range(30_000).select("id", F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": "'), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(4)], F.lit('"')).alias("member"), (F.col("id") % 5).alias("document"))
    writers.json_documents(rows, f"file://{tmp_path}/docs", "{}", "member", "id")
    files = sorted((tmp_path / "docs").rglob("part-*.txt"))
    assert [p.parent.name for p in files] == [f"document={k}" for k in range(5)]
    assert [list(json.loads(p.read_text())) for p in files] == [[str(i) for i in range(k, 30_000, 5)] for k in range(5)]


def test_a_file_for_each_row(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit(f"file://{tmp_path}/d"), (F.col("id") % 3).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("té"), "id").alias("text"))
    writers.by_file(rows)
    writers.by_file(rows)  # a task that runs again
    assert sorted(p.read_text(encoding="utf-8") for p in tmp_path.rglob("*.txt")) == sorted(f"té{k}" for k in range(20))


MARKUPS = [
    None, "", "<p>no table</p>", "<table></table>", '<table><tr><td rowspan="3">a</td><td colspan="2">b</td></tr><tr><th>c</th></tr><tr></tr><tr><td>d</td></tr></table>',
    '<table><tr><td rowspan="2" colspan="2">a</td></tr><tr><td>b</td><td rowspan="x">c</td></tr></table>',
]


def test_table_functions_in_sql_and_frames(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame(list(enumerate(MARKUPS)), "k int, markup string").withColumn("cell_idx", F.lit("mine"))
    rows.createOrReplaceTempView("some_markup")
    want = [(k, n, c.r0, c.r1, c.c0, c.c1, c.text, c.header) for k, m in enumerate(MARKUPS) for n, c in enumerate(markup.logical_cells(m))]
    got = spark.sql("SELECT t.k, c.* FROM some_markup t, LATERAL cells_of_markup(t.markup) c")
    assert sorted(map(tuple, got.collect())) == want
    tokens = spark.createDataFrame([(1, ["fcel", "lcel", "nl", "ucel", "ecel", "fcel", "nl", "nl"], 2), (2, None, None), (3, [], 0)], "k int, tokens array<string>, n int")
    got = sorted(tuple(r)[3:] for r in tokens.lateralJoin(table_functions.cells_of_otsl(F.col("tokens").outer())).collect())
    assert got == [(k, c.r0, c.r1, c.c0, c.c1, c.header) for k, c in enumerate(markup.otsl_cells(["fcel", "lcel", "nl", "ucel", "ecel", "fcel", "nl", "nl"]))]
    html = spark.createDataFrame([(1, ["<tr>", "<td", ' colspan="2"', ">", "</td>", "<td>", "</td>", "</tr>"], 1), (2, None, None)], "k int, tokens array<string>, n int")
    assert [tuple(r)[3:] for r in html.lateralJoin(table_functions.cells_of_tokens(F.col("tokens").outer(), F.col("n").outer())).collect()] == [(0, 0, 1, 0, 2)]


def test_tracks(spark):
    items = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (1, 11.0), (1, None), (2, 5.0), (9, 1.0)], "sample long, position double")
    sizes = spark.createDataFrame([(1, 2, 0.0, 20.0), (2, 3, 0.0, 9.0), (3, 2, 0.0, 10.0), (4, 2, 0.0, 10.0)], "sample long, n int, low double, high double")
    ruled = spark.createDataFrame([(4, 7.0), (4, 1.0), (4, 3.0), (4, 3.0), (4, 9.0), (2, 4.0)], "sample long, position double")
    got: dict[int, list] = {}
    for r in tracks.track_edges(items, sizes, ruled).orderBy("sample", "k").collect():
        got.setdefault(r["sample"], []).append((r["edge"], r["source"]))
    assert got == {1: [(e, "distribution") for e in (0.0, 6.0, 20.0)], 2: [(e, "distribution") for e in (0.0, 5.0, 5.0, 9.0)], 3: [(e, "uniform") for e in (0.0, 5.0, 10.0)], 4: [(e, "line") for e in (1.0, 3.0, 7.0)]}


def test_tracks_of_many_tables_at_once(monkeypatch):
    """Small tables of one size are one pass of arrays, with the edges that each has by itself; only others are done one by one."""
    rng, rows = random.Random(5), []
    for _ in range(600):
        places = sorted(rng.sample(range(30), rng.randint(0, 9)))
        rows.append((places, [rng.randint(1, 3) for _ in places], sorted(rng.sample(range(50), rng.choice((0, 0, 0, 3)))), rng.randint(0, 4), 0.0, 100.0))
    rows.append((list(range(0, 120, 3)), [1] * 40, [], 3, 0.0, 200.0))
    names, kinds = ("positions", "times", "lines", "n", "low", "high"), (pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.float64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    want = [diffs.grid_edges(list(map(float, lines)), list(map(float, x)), n, low, high, times) for x, times, lines, n, low, high in rows]
    single, one = [], diffs.grid_edges
    monkeypatch.setattr(diffs, "grid_edges", lambda *a: single.append(a) or one(*a))
    edges, source = tracks.edges_of_batch(batch)
    assert [(list(map(float, e)), s) for e, s in zip(edges, source, strict=True)] == want
    assert len(single) == sum(not x or n == 0 or len(lines) > n or len(x) > tracks.MANY for x, _, lines, n, *_ in rows) < 400


def test_written_rows_and_the_shared_folder(spark):
    assert session.written(spark.range(5), "some").count() == 5
    assert session.folder(spark, "x").startswith(session.shared_folder(spark))
    assert session.is_local(spark)
