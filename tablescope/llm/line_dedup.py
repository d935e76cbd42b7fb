"""Line dedup by content-defined chunks of lines.

A text's lines are cut into chunks where a rolling hash over the last WINDOW lines' hashes has TAIL zero bits, so that
boundaries depend on the lines near them alone and come back after insertions and deletions elsewhere. A chunk of at
least MIN_LINES lines, of however few bytes, whose bytes occur more than once in the corpus stays at its first place (by
document, then place) and goes from all others. Equal hashes are only candidates: chunks are removed after their bytes
have been compared with the kept one's.

Occurrences of a chunk are not gathered: a chunk's first place is a minimum, added up in each task first, and the others
are joined with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, encoded, mix, packed_rows, run_hashes, unpacked_rows, written

WINDOW = 2
TAIL = 1
MIN_LINES, MAX_LINES = 2, 16
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def cut_all(rows: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, end, lines, hash) of the chunks of some texts, in order; lines keep their newlines, and the chunks make up the texts."""
    raw = np.frombuffer(b"".join(rows), np.uint8)
    if not len(raw):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    last = np.cumsum(size)
    ends = np.unique(np.concatenate((np.flatnonzero(raw == 10) + 1, last[size > 0])))
    starts = np.concatenate(([0], ends[:-1]))
    of = np.searchsorted(last, starts, side="right")
    # a last line without its newline is the same line
    body = np.where(raw[ends - 1] == 10, ends - 1, ends)
    lines = np.zeros(len(ends), np.uint64)
    full = body > starts
    lines[full] = run_hashes(raw, starts[full], body[full])
    rolling = lines.copy()
    for back in range(1, WINDOW):
        rolling[back:] += np.where(of[back:] == of[:-back], lines[:-back] * np.uint64(pow(int(_ROLL), back, 1 << 64)), np.uint64(0))
    stop = ((mix(rolling) & np.uint64((1 << TAIL) - 1)) == 0).tolist()
    whole = np.append(of[1:] != of[:-1], True).tolist()  # a text's last line
    lead, first = [], 0
    for k, (cut, end) in enumerate(zip(stop, whole, strict=True)):
        if end or k + 1 - first >= MAX_LINES or (cut and k + 1 - first >= MIN_LINES):
            lead.append(first)
            first = k + 1
    lead = np.asarray(lead)
    tail = np.append(lead[1:], len(ends)) - 1
    many = tail - lead + 1
    inside = np.arange(len(ends)) - np.repeat(lead, many) + 1
    name = mix(np.bitwise_xor.reduceat(mix(lines + inside.astype(np.uint64) * _ROLL), lead)).view(np.int64)
    shift = (last - size)[of[lead]]
    return of[lead], starts[lead] - shift, ends[tail] - shift, many, name


def cuts(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, lines, hash) of a text's chunks, in order."""
    return list(zip(*(x.tolist() for x in cut_all([data])[1:]), strict=True))


def chunks(docs: DataFrame) -> DataFrame:
    """doc, row, start, end, name and bytes (without a last newline) of each chunk of several lines."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            data = encoded(part.column("text"))
            of, start, end, lines, name = cut_all(data)
            some = lines >= MIN_LINES
            of, start, end, name = of[some], start[some], end[some], name[some]
            body = pa.array([data[k][a:b].rstrip(b"\n") for k, a, b in zip(of.tolist(), start.tolist(), end.tolist(), strict=True)], pa.binary())
            row, doc = (np.asarray(part.column(c))[of] for c in ("row", "doc"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (row, doc, start, end, name)), body], names=["row", "doc", "start", "end", "name", "bytes"])

    return docs.mapInArrow(each, "row long, doc long, start long, end long, name long, bytes binary")


def removed_chunks(docs: DataFrame) -> DataFrame:
    """doc, row and the places (start, end) of the chunks to be removed, from docs with doc, row and text.

    Chunks are grouped by their bytes: that is the comparison. Only groups of several go on, with a second hash that
    tells apart different bytes of one name, and if even that is shared, none of them is removed. Both sides of the join
    with the chunks' places are tables, so that Spark can deal a very frequent chunk out anew.
    """
    every = chunks(docs)
    here = F.struct("doc", "row", "start")
    groups = every.groupBy("name", "bytes").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").select("name", F.xxhash64("bytes").alias("check"), "first")
    sole = written(written(groups, "line-groups").groupBy("name", "check").agg(F.min("first").alias("first"), F.count("*").alias("same")).where("same = 1").drop("same"), "line-firsts")
    places = written(every.select("name", F.xxhash64("bytes").alias("check"), "doc", "row", "start", "end"), "line-chunks")
    return places.join(sole, ["name", "check"]).where(here != F.col("first")).groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cut"))


def kept_text(data: bytes, cut: list[dict]) -> bytes:
    """What is left of a text without the chunks at some places, in order."""
    edge = [0, *(x for c in cut for x in (c["start"], c["end"])), len(data)]
    return b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks of lines removed from `text`, and n_chars, if there is such a column, set anew.

    The first place is that of the smallest doc_id, null last, then of the least hash, then the first in the text. Rows
    equal in doc_id and text are one place, so that equal rows stay equal. A null text stays null; a text of a single line
    has no chunk of several; a text all of whose chunks are repeated becomes empty; no rows, no rows. Other columns, of any
    names, pass as they are.
    """
    text = F.col("text").cast("string")
    doc, row = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(text, F.lit(""))).alias("row")
    plain = docs.where(F.col("text").isNotNull()).select(doc.alias("doc"), row, F.encode(text, "UTF-8").alias("text"))
    cut = removed_chunks(plain).withColumnRenamed("doc", "id")
    marked = packed_rows(docs.withColumn("text", text), doc, row).join(cut, ["id", "row"], "left").select("doc", "cut")
    at = [c.lower() for c in docs.columns].index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            fields, texts = rows.flatten(), rows.field(at).to_pylist()
            for k, some in enumerate(batch.column(1).to_pylist()):
                if some and texts[k] is not None:
                    texts[k] = kept_text(texts[k].encode(), some).decode()
            fields[at] = pa.array(texts, rows.type.field(at).type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(rows.type))], names=["doc"])

    out = marked.mapInArrow(each, T.StructType([marked.schema["doc"]]))
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(F.col("doc").getField("text")).cast(docs.schema["n_chars"].dataType)
    return unpacked_rows(out, docs.columns, **changed)
