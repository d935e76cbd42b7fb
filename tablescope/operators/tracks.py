"""Rows and columns of tables from positions: the edges of each table's tracks, as an operator over items, ruling lines and sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diffs

#: Tables of more different positions are done one by one, by halves.
MANY = 32


def edges_of_batch(batch: pa.RecordBatch) -> tuple[list, list[str]]:
    """Edges and source of each row of a batch (positions, times, lines, n, low, high): tables of equally many positions and tracks at once."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    length = lambda c: np.asarray(pc.list_value_length(column(c)).fill_null(0)).astype(np.int64)
    size, ruled = length("positions"), length("lines")
    known = np.ones(len(size), bool)
    for c in ("n", "low", "high"):
        known &= np.asarray(column(c).is_valid())
    n, low, high = (np.asarray(column(c).fill_null(0)) for c in ("n", "low", "high"))
    x, times = (np.asarray(column(c).flatten()) for c in ("positions", "times"))
    start = np.cumsum(size) - size
    quick = known & (n > 0) & (ruled <= n) & (size > 0) & (size <= MANY) & (n <= MANY)
    edges, source = [None] * len(size), ["distribution"] * len(size)
    for m, k in np.unique(np.column_stack((size, n))[quick], axis=0).tolist():
        mine = np.flatnonzero(quick & (size == m) & (n == k))
        at = start[mine][:, None] + np.arange(m)
        mine, at = (v[(np.diff(x[at], axis=1) > 0).all(axis=1) & np.isfinite(x[at]).all(axis=1)] for v in (mine, at))
        middle = diffs.centres_of_many(x[at], times[at], k)
        whole = np.column_stack((low[mine], np.rint((middle[:, 1:] + middle[:, :-1]) / 2), high[mine]))
        for row, found in zip(mine.tolist(), whole.tolist(), strict=True):
            edges[row] = found
    for row in (r for r, e in enumerate(edges) if e is None):
        lines, places, many, *rest = (column(c)[row].as_py() for c in ("lines", "positions", "times", "n", "low", "high"))
        edges[row], source[row] = diffs.grid_edges(lines or [], places or [], int(rest[0]), *rest[1:], many or [])
    return edges, source


def track_edges(items: DataFrame, sizes: DataFrame, ruled: DataFrame | None = None) -> DataFrame:
    """sample, k, edge and source of the n + 1 edges of each table of sizes (sample, n, low, high).

    From the first ruling lines (sample, position), if there are more than n; else half-way between the centres of n groups of
    the items' positions (sample, position); else in even steps. Equal positions are counted before a table's different ones,
    which are all that meets in one row, are gathered. Null positions count for nothing; a table without items has even steps.
    """
    counted = items.where("position IS NOT NULL").groupBy("sample", F.col("position").cast("double").alias("position")).agg(F.count("*").alias("times"))
    places = counted.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("position", "times"))).alias("places"))
    places = places.select("sample", F.col("places.position").alias("positions"), F.col("places.times").alias("times"))
    rows = sizes.select("sample", "n", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")).join(places, "sample", "left")
    if ruled is None:
        rows = rows.withColumn("lines", F.array().cast("array<double>"))
    else:
        rows = rows.join(ruled.groupBy("sample").agg(F.sort_array(F.collect_set(F.col("position").cast("double"))).alias("lines")), "sample", "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, source = edges_of_batch(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(edges, pa.list_(pa.float64())), pa.array(source, pa.string())], names=["sample", "edges", "source"])

    found = rows.select("sample", "positions", "times", "lines", "n", "low", "high").mapInArrow(each, f"sample {rows.schema['sample'].dataType.simpleString()}, edges array<double>, source string")
    return found.select("sample", F.posexplode("edges").alias("k", "edge"), "source")
