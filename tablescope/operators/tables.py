"""Markup operators over DataFrames: one Arrow pass over the pure kernels, one struct or many rows out of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import align, geometry, markup, trees
from ..functions.text import kernel_column, occurrences, rich_text, without_tags
from . import reconstruct

CELLS = "sample long, cell_idx int, r0 int, r1 int, c0 int, c1 int, text string, header boolean"


def logical_cells(tables: DataFrame, nested: bool = False) -> DataFrame:
    """A row for each logical cell, half-open, of tables (sample, markup)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [markup.logical_cells(m, nested) for m in batch.column(1).to_pylist()]
            many = np.fromiter(map(len, found), np.int64, len(found))
            of = np.repeat(np.arange(len(found)), many)
            cells = [c for some in found for c in some]
            numbers = [np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many), *([getattr(c, side) for c in cells] for side in ("r0", "r1", "c0", "c1"))]
            columns = [batch.column(0).cast(pa.int64()).take(pa.array(of)), *(pa.array(v, pa.int32()) for v in numbers), pa.array([c.text for c in cells], pa.string()), pa.array([bool(c.header) for c in cells], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["sample", "cell_idx", "r0", "r1", "c0", "c1", "text", "header"])

    return tables.select("sample", "markup").mapInArrow(each, CELLS)


def cell_lists(tables: DataFrame) -> DataFrame:
    """sample, n (rows) and the texts of the cells in order, of tables (sample, markup) that have cells."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [markup.cell_texts(m) for m in batch.column(1).to_pylist()]
            kept = [k for k, (_, texts) in enumerate(found) if texts]
            texts = pa.array([found[k][1] for k in kept], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(kept, pa.int64())), pa.array([found[k][0] for k in kept], pa.int32()), texts], names=["sample", "n", "texts"])

    return tables.select("sample", "markup").mapInArrow(each, "sample long, n int, texts array<string>")


def annotation_places(tokens: pa.Array, contents: pa.Array) -> pa.Array:
    """The places (r0, r1, c0, c1) of the annotated cells of each list of structure tokens with so many contents. Equal ones are read once: annotations have few structures."""
    text = tokens.flatten().cast(pa.string())
    if tokens.null_count or text.null_count or contents.null_count:
        keys, lists = list(range(len(tokens))), tokens.to_pylist()
    else:
        _, offsets, data = text.buffers()
        ends = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
        data = memoryview(data) if data else memoryview(b"")
        edge = np.concatenate(([0], np.cumsum(np.asarray(tokens.value_lengths()))))
        sizes, of = np.diff(ends), edge.tolist()
        keys = [(n, data[x:y].tobytes(), sizes[a:b].tobytes()) for n, a, b, x, y in zip(contents.to_pylist(), of[:-1], of[1:], ends[edge[:-1]].tolist(), ends[edge[1:]].tolist(), strict=True)]
        lists = None
    number: dict = {}
    which = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(keys))
    one = np.zeros(len(number), np.int64)
    one[which[::-1]] = np.arange(len(keys))[::-1]
    found = [markup.annotated_cells(list(lists[k] if lists else tokens[k].as_py()), int(contents[k].as_py()))[0] for k in one.tolist()]
    many = np.fromiter(map(len, found), np.int64, len(found))
    first, size = np.cumsum(many) - many, many[which]
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[which], size)
    sides = [np.fromiter((getattr(c, side) for cells in found for c in cells), np.int32, int(many.sum()))[place] for side in ("r0", "r1", "c0", "c1")]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in sides], ["r0", "r1", "c0", "c1"]))


def annotation_cells(rows: DataFrame) -> DataFrame:
    """Of annotations (sample, tokens, cells: array of struct(tokens, bbox)) each logical cell with its content: sample, cell_idx, r0, r1, c0, c1, text, numbers, box. A table ends at the first cell without a content."""
    places = F.arrow_udf(annotation_places, "array<struct<r0: int, r1: int, c0: int, c1: int>>")(F.col("tokens"), F.size("cells"))
    # each place has its content beside it, so that no row carries all of its table's
    both = F.transform("__p", lambda p, i: F.struct(p.alias("p"), F.get("cells", i).alias("content")))
    found = rows.withColumn("__p", places).select("sample", F.posexplode(both).alias("cell_idx", "c"))
    content = F.col("c.content")
    return found.select("sample", "cell_idx", "c.p.*", rich_text(content["tokens"]).alias("text"), content["bbox"].alias("numbers"), geometry.from_numbers(content["bbox"]).alias("box"))


def recognised_tokens(cells: DataFrame, words: bool = False, include_empty: bool = False) -> DataFrame:
    """Of cells (sample, cell_idx, text, box) the tokens that a recogniser would have found: one for each cell with a box and visible text, or one for each word, boxes by the words' lengths. sample, id (from 1), text, box, line, index_in_line, confidence."""
    shown = F.trim(without_tags(F.col("text")))
    some = cells.where("box IS NOT NULL").withColumn("text", F.when(shown == "", F.lit(" ")).otherwise(F.col("text")) if include_empty else F.col("text"))
    some = some if include_empty else some.where(shown != "")
    if words:  # cells are numbered, not their words: half the rows or less are sorted
        w = W.partitionBy("sample").orderBy("cell_idx").rowsBetween(W.unboundedPreceding, -1)
        many = F.size(F.filter(F.split(F.trim("text"), "\\s+"), lambda x: x != ""))
        lines = some.select("sample", "cell_idx", "text", "box", F.coalesce(F.sum(many).over(w), F.lit(0)).alias("before"))
        split = lines.select("sample", "before", F.col("cell_idx").alias("line"), F.posexplode(reconstruct.boxed_words(F.col("text"), F.col("box"))).alias("nth", "w"))
        return split.select("sample", (F.col("before") + F.col("nth") + 1).cast("int").alias("id"), F.col("w.word").alias("text"), F.col("w.box").alias("box"), "line", F.col("w.word_idx").alias("index_in_line"), F.lit(1.0).alias("confidence"))
    found = some.select("sample", F.col("cell_idx").alias("line"), F.lit(0).alias("index_in_line"), "text", "box")
    at = F.row_number().over(W.partitionBy("sample").orderBy("line", "index_in_line"))
    return found.select("sample", at.alias("id"), "text", "box", "line", "index_in_line", F.lit(1.0).alias("confidence"))


def markup_statistics(html: Column) -> Column:
    """struct: rows, cells, spans, empty cells, sections and their rows, counted in the markup itself."""
    n = lambda part: F.regexp_count(html, F.lit(part)).cast("long")
    inside = lambda tag: F.aggregate(F.regexp_extract_all(html, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1), F.lit(0).cast("long"), lambda s, x: s + F.regexp_count(x, F.lit("<tr>")).cast("long"))
    fields = {"tr": n("<tr>"), "td": n("<td"), "rowspan": n("rowspan="), "colspan": n("colspan="), "empty_td": n("<td[^>]*>\\s*</td>"), "thead": n("<thead>"), "tbody": n("<tbody>"), "thead_tr": inside("thead"), "tbody_tr": inside("tbody")}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def inline_statistics(html: Column) -> Column:
    """struct: how often each tag of formatting begins, and style attributes."""
    n = lambda part: F.regexp_count(html, F.lit(part)).cast("long")
    return F.struct(*(n(f"<{t}[ >]").alias(t) for t in ("b", "i", "sup", "sub")), n("style=").alias("style"))


def similarity(pred: Column, true: Column, policy: str = "none", ignore: tuple[str, ...] = ()) -> Column:
    """struct(teds_s, teds, error): the test for equal tables is inside, so that it spares the work."""
    if policy not in markup.POLICIES:
        raise ValueError(f"no policy {policy}")

    def each(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([markup.similarities(x, y, policy, ignore) for x, y in zip(a, b, strict=True)], columns=["teds_s", "teds", "error"])

    return F.pandas_udf(each, "teds_s double, teds double, error string")(F.coalesce(pred, F.lit("")), true)


def scored_pairs(pred: DataFrame, true: DataFrame, policy: str = "none", parts: int | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """sample, policy, edit_distance, teds_s, teds, error; a missing prediction is scored as empty. Pairs are dealt out at random, as their cost differs, not their number."""
    both = true.select("sample", F.col("markup").alias("true")).join(pred.select("sample", F.col("markup").alias("pred")), "sample", "left")
    if parts:
        both = both.repartition(parts, F.xxhash64("sample"))
    scored = both.withColumn("s", similarity(F.col("pred"), F.col("true"), policy, ignore))
    p = F.coalesce("pred", F.lit(""))
    distance = kernel_column(trees.text_distance, p, F.col("true"), kind="int") / F.greatest(F.length(p), F.length("true"), F.lit(1))
    return scored.select("sample", F.lit(policy).alias("policy"), distance.alias("edit_distance"), "s.teds_s", "s.teds", "s.error")


ALIGNED = "cells int, nonempty_cells int, regions int, mapped_cells int, skipped_regions int, coverage double, weighted_similarity double, reason string"


def alignment(cells: Column, regions: Column) -> Column:
    """The alignment report of two arrays of texts."""

    def each(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(align.judge_all([(list(x), list(y)) for x, y in zip(a, b, strict=True)]), columns=[f.split()[0] for f in ALIGNED.split(", ")])

    return F.pandas_udf(each, ALIGNED)(cells, regions)


def alignment_value(cells: Column, regions: Column) -> Column:
    """The value of the best path of two arrays of texts."""

    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([value for _, _, value in align.align_all([(list(x), list(y)) for x, y in zip(a, b, strict=True)])], dtype=float)

    return F.pandas_udf(each, "double")(cells, regions)


def markup_counts(html: Column) -> list[Column]:
    """Counts of tags and attributes as plain substrings; '<th' counts '<thead' too."""
    n = lambda part, name: occurrences(html, part).alias(name)
    return [n("<tr>", "rows"), n("<td", "cells"), n("rowspan=", "rowspans"), n("colspan=", "colspans"), n("<th", "headers"), n("<br", "breaks"), n("style=", "styles"), F.regexp_count(html, F.lit("<td[^>]*>[ \\t\\r\\n]*</td>")).cast("long").alias("empty_cells")]


def grid_difference(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Places compared and places that differ, by sample, of logical cells spread over all their places."""
    spread = lambda cells, name: cells.select("sample", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "c0", "c1", "text").select("sample", "r", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c"), F.col("text").alias(name))
    both = spread(pred, "a").join(spread(true, "b"), ["sample", "r", "c"], "full")
    return both.groupBy("sample").agg(F.count("*").alias("compared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))


def register(spark: SparkSession) -> None:
    """The scalar kernels as SQL functions."""
    spark.udf.register("table_cells", F.pandas_udf(lambda s: s.map(lambda m: len(markup.logical_cells(m))), "int"))
    for name in markup.POLICIES:
        spark.udf.register(f"teds_{name}", F.pandas_udf(lambda a, b, name=name: pd.Series([markup.similarity(x, y, name)[0] for x, y in zip(a, b, strict=True)]), "double"))
