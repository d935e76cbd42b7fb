"""Members of JSON objects and arrays that fill whole files, each file read by as many tasks as it has splits.

Files are read as text whose lines end at commas, so that Spark splits them like any text and any store will do. Whether a split
begins inside a string, and how deep, follows from those before it: a first pass notes of each split how often it changes between
inside and outside, and how the depth changes if it begins outside and if it begins inside. Running sums over a file's splits,
a row each, give the states. In the second pass each task cuts its split at the commas of depth one; what a cut leaves at the
ends of splits is put together by file. No file is ever whole in one task or string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written

_COMMA, _QUOTE, _BACK = ord(","), ord('"'), ord("\\")
#: Bytes that are looked at together; a longer piece between two commas is one part.
PART = 1 << 22
WHOLE, ON, BEGUN = 0, 1, 2


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """value, file and block (where its split begins) of what stands between commas, in the order of each split."""
    return spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, bytes]]:
    """Pieces of one split, as bytes with their commas, in parts, with their key (file, block) and first row."""
    for batch in batches:
        file, block = batch.column("file"), np.asarray(batch.column("block"))
        if not len(block):
            continue
        other = np.asarray(pc.not_equal(file.slice(1), file.slice(0, len(block) - 1)).cast(pa.int8()))
        edge = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (other == 1)))).tolist()
        for a, b in zip(edge, [*edge[1:], len(block)], strict=True):
            part, size = [], 0
            for value in batch.column("value").slice(a, b - a).to_pylist():
                part.append(value.encode())
                size += len(part[-1]) + 1
                if size > PART:
                    yield (file[a].as_py(), int(block[a])), batch.slice(a, 1), b",".join(part) + b","
                    part, size = [], 0
            if part:
                yield (file[a].as_py(), int(block[a])), batch.slice(a, 1), b",".join(part) + b","


def lexed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte how many quotes stand before it, and its change of depth, for structure outside of strings. A part ends with a comma, which no backslash can stand before."""
    quote = data == _QUOTE
    if (back := np.flatnonzero(data == _BACK)).size:
        first = np.flatnonzero(np.concatenate(([True], np.diff(back) > 1)))
        size = np.diff(np.append(first, len(back)))
        behind = back[first] + size  # the byte behind a run of backslashes, which an odd run takes for itself
        behind = behind[(size % 2 == 1) & (behind < len(data))]
        quote[behind] = False
    before = np.cumsum(quote) - quote
    step = np.zeros(len(data), np.int64)
    step[(data == ord("{")) | (data == ord("["))] = 1
    step[(data == ord("}")) | (data == ord("]"))] = -1
    return before, step


STATES = "file string, block long, flips long, outside long, inside long"


def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list[int]] = {}
    for key, _, text in runs(batches):
        data = np.frombuffer(text, np.uint8)
        before, step = lexed(data)
        even, odd = int(step[before % 2 == 0].sum()), int(step[before % 2 == 1].sum())
        state = found.setdefault(key, [0, 0, 0])
        if state[0] % 2:
            even, odd = odd, even
        state[0] += int(before[-1])
        state[1] += even
        state[2] += odd
    rows = [(*key, *state) for key, state in found.items()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["file", "block", "flips", "outside", "inside"])


def states(found: DataFrame) -> DataFrame:
    """file, block, in_string and depth where each split begins."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = found.mapInArrow(noted, STATES).withColumn("in_string", earlier("flips") % 2)
    rows = rows.withColumn("change", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    return rows.select("file", "block", "in_string", earlier("change").alias("depth"))


class Cutter:
    """Cuts one split at the commas of depth one; what is open at its ends is marked as begun or going on."""

    def __init__(self, in_string: int, depth: int, opening: int) -> None:
        self.in_string, self.depth, self.opening = in_string, depth, opening
        self.held: list[bytes] | None = [] if depth else None  # of a member that is open
        self.kind = ON if depth else BEGUN
        self.out: list[tuple[int, bytes]] = []

    def feed(self, text: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        before, step = lexed(data)
        outside = (before + self.in_string) % 2 == 0
        depth = np.cumsum(np.where(outside, step, 0)) + self.depth
        opens, closes = outside & (step == 1) & (depth == 1), outside & (step == -1) & (depth == 0)
        if (wrong := opens & (data != self.opening)).any():
            raise ValueError(f"a document begins with {chr(data[np.argmax(wrong)])}, not with {chr(self.opening)}")
        at = 0
        for k in np.flatnonzero(opens | closes | (outside & (data == _COMMA) & (depth == 1))).tolist():
            if self.held is not None:
                self.held.append(text[at:k])
                self.out.append((WHOLE if self.kind == BEGUN else ON, b"".join(self.held)))
            self.held, self.kind, at = (None if closes[k] else []), BEGUN, k + 1
        if self.held is not None:
            self.held.append(text[at:])
        self.depth = int(depth[-1])
        self.in_string = (self.in_string + int(before[-1])) % 2

    def end(self) -> None:
        if self.held is not None:
            self.out.append((self.kind, b"".join(self.held)))


def members(spark: SparkSession, path: str, opening: str) -> DataFrame:
    """file and member, the text of each member of the documents at `path` (`"key": value` of objects, the element of arrays).

    The states are a row for each split, of which the driver keeps a description anyway: they are broadcast. A document that
    begins with another bracket is an error.
    """
    found = pieces(spark, path)
    first = ord(opening)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, number = None, None, 0

        def taken() -> pa.RecordBatch:
            nonlocal number
            n = len(cutter.out)
            arrays = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), pa.array([k for k, _ in cutter.out], pa.int32()), pa.array([x.decode() for _, x in cutter.out], pa.string())]
            number += n
            cutter.out = []
            return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "nth", "kind", "member"])

        for now, row, text in runs(batches):
            if now != key:
                if cutter:
                    cutter.end()
                    yield taken()
                key, number = now, 0
                cutter = Cutter(row.column("in_string")[0].as_py(), row.column("depth")[0].as_py(), first)
            cutter.feed(text)
            yield taken()
        if cutter:
            cutter.end()
            yield taken()

    rows = found.join(F.broadcast(written(states(found), "states")), ["file", "block"]).select("value", "file", "block", "in_string", "depth")
    parts = rows.mapInArrow(cut, "file string, block long, nth long, kind int, member string")
    ends = parts.where(F.col("kind") != WHOLE)
    number = F.sum((F.col("kind") == BEGUN).cast("int")).over(W.partitionBy("file").orderBy("block", "nth"))
    whole = ends.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "nth", "member"))).alias("parts"))
    put = whole.select("file", F.array_join(F.transform("parts", lambda p: p["member"]), "").alias("member"))
    return parts.where(F.col("kind") == WHOLE).select("file", "member").union(put).where(F.trim(F.regexp_replace("member", "\\s+", " ")) != "")


def parsed(text: Column, kind: str) -> Column:
    """A member as a value; what is no JSON is an error."""
    return F.from_json(text, kind, {"mode": "FAILFAST"})


def object_members(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and value of each member of JSON objects; a key that comes twice has two rows."""
    pair = parsed(F.concat(F.lit("{"), "member", F.lit("}")), f"map<string, {value}>")
    return members(spark, path, "{").select(F.explode(pair).alias("key", "value"))


def array_elements(spark: SparkSession, path: str, element: str) -> DataFrame:
    """value of each element of JSON arrays."""
    return members(spark, path, "[").select(F.element_at(parsed(F.concat(F.lit("["), "member", F.lit("]")), f"array<{element}>"), 1).alias("value"))
