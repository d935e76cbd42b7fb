"""Exact top-k search over an impact-ordered index, score at a time.

Vectors are cut into blocks. In a block, each dimension's entries are quantised to levels of STEP units, and the entries of
one level form a posting segment. For a query, segments come in descending order of their impact |q * level * STEP|; each
adds its impact to its members' accumulators. Whatever has not been added is bounded: by the largest impact still to come
in each dimension, and by the part of an entry below its level. A vector that cannot reach the k-th best lower bound is
out; processing stops only when few remain, or all segments are done, and those that remain are scored exactly. The
result is exact in any case. Queries come in blocks too and meet every block of vectors once, in a grid of cells of a few
blocks each, so that no cell grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

SCALE = 1024
STEP = 64
#: Vectors of an index block; blocks of vectors and blocks with queries of a cell of the grid.
BLOCK, HIGH, ACROSS = 16384, 4, 16
#: Processing may stop once this many times k vectors are possible members.
ENOUGH = 16


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and the whole numbers floor(1024 * x). Vectors that are null, or hold null or a number that is not finite, are left out, and so are rows without vec_id."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", whole.alias("v"))


BLOCKS = "width int, block long, ids binary, asked binary, entries binary"


def narrowest(values: np.ndarray) -> bytes:
    """Whole numbers as little-endian ones of the fewest bytes that hold them, after a byte that says how many."""
    most = int(np.abs(values).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], {2: np.int16, 4: np.int32, 8: np.int64}[data[0]]).astype(np.int64)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, v, asked) packed into numbered blocks of one width each: ids, which rows are queries, and entries. A row is known by its block and its place there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        number = TaskContext.get().partitionId() << 32

        def out(width: int) -> pa.RecordBatch:
            nonlocal number
            ids, asked, rows = held.pop(width)
            number += 1
            packed = {"ids": np.asarray(ids, np.int64).tobytes(), "asked": np.asarray(asked, np.uint8).tobytes(), "entries": narrowest(np.concatenate([np.zeros(0, np.int64), *rows]))}
            return pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "block": pa.array([number], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in packed.items()})

        for batch in batches:
            col = batch.column(1)
            offsets, values = np.asarray(col.offsets), np.asarray(col.values).astype(np.int64)
            for k, (vec_id, asked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                row = values[offsets[k] : offsets[k + 1]]
                ids, which, rows = held.setdefault(len(row), ([], [], []))
                ids.append(vec_id)
                which.append(bool(asked))
                rows.append(row)
                if len(ids) == size:
                    yield out(len(row))
        for width in list(held):
            yield out(width)

    return rows.mapInArrow(each, BLOCKS)


def queries_of(blocks_: DataFrame) -> DataFrame:
    """The blocks' queries alone, in the same columns; `asked` holds their places as 64-bit numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["asked"], np.uint8))
                if len(at):
                    mine = widened(row["entries"]).reshape(-1, row["width"])[at] if row["width"] else np.zeros((len(at), 0), np.int64)
                    packed = {"ids": np.frombuffer(row["ids"], np.int64)[at].tobytes(), "asked": at.astype(np.int64).tobytes(), "entries": narrowest(mine.ravel())}
                    yield pa.RecordBatch.from_pydict({"width": pa.array([row["width"]], pa.int32()), "block": pa.array([row["block"]], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in packed.items()})

    return blocks_.mapInArrow(each, BLOCKS)


class Index:
    """The posting segments of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        level = vectors // STEP
        self.segments = []  # for each dimension: levels, ascending, and their members
        for d in range(vectors.shape[1]):
            order = np.argsort(level[:, d], kind="stable")
            levels, first = np.unique(level[order, d], return_index=True)
            self.segments.append([(int(x), m) for x, m in zip(levels, np.split(order, first[1:]), strict=True) if len(m)])
        self.visited = 0

    def search(self, query: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best but the one at place `without`, ties to smaller ids."""
        n = len(self.ids)
        plan = sorted(((abs(int(q) * x * STEP), d, x, m) for d, q in enumerate(query) if q for x, m in self.segments[d] if x), key=lambda s: -s[0])
        up = np.zeros(len(query), np.int64)  # the largest impact still to come, by dimension, above and below zero
        down = np.zeros(len(query), np.int64)
        rests = STEP - 1
        high = int(query[query > 0].sum()) * rests
        low = int(query[query < 0].sum()) * rests
        todo: list[dict] = [{} for _ in query]
        for _, d, x, _m in plan:
            impact = int(query[d]) * x * STEP
            todo[d][x] = impact
        for d, levels in enumerate(todo):
            up[d], down[d] = max([0, *levels.values()]), min([0, *levels.values()])
        ups = [sorted(v for v in levels.values() if v > 0) for levels in todo]
        downs = [sorted((v for v in levels.values() if v < 0), reverse=True) for levels in todo]
        sums = np.zeros(n, np.int64)
        check = max(1, len(plan) // 8)
        alive = np.arange(n)
        for at, (_, d, x, members) in enumerate(plan, 1):
            impact = int(query[d]) * x * STEP
            sums[members] += impact
            (ups[d] if impact > 0 else downs[d]).pop()
            if at % check == 0 or at == len(plan):
                above = high + sum(v[-1] for v in ups if v)
                under = low + sum(v[-1] for v in downs if v)
                if n > k + 1:
                    kth = np.partition(sums, n - k - 1)[n - k - 1] + under  # one more than k: the query itself may be among them
                    alive = np.flatnonzero(sums + above >= kth)
                self.visited = at
                if len(alive) <= ENOUGH * k:
                    break
        if without is not None:
            alive = alive[alive != without]
        scores = self.vectors[alive] @ query
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive][best], scores[best]


def search(vectors: DataFrame, is_query: F.Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows but the query's own, by whole-number inner product, ties to smaller vec_id.

    Vectors of another number of entries than the query's are no candidates. Every row is a row of its own: rows that share
    a vec_id are all candidates, of each other too, and each of them that is a query has k results. Fewer than k
    candidates: all of them; none: no row. Other columns are not read.
    """
    stored = written(blocks(quantised(vectors).select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asked")), BLOCK), "vector-blocks")
    number = max(1, stored.count())
    # Every block of vectors meets the queries of every block of its width: the stated queries against all rows, in blocks.
    # The grid has a cell for each few blocks of either side, and a block is sent once to each cell of its row or column.
    rows, columns = -(-number // HIGH), -(-number // ACROSS)
    spread = F.pmod(F.xxhash64("block", "width"), F.lit(rows)).cast("int"), F.pmod(F.xxhash64("width", "block", F.lit(1)), F.lit(columns)).cast("int")

    def along(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    names = ["width", "block", "ids", "asked", "entries"]
    whole = stored.select(*names, spread[0].alias("i"), along(columns).alias("j"))
    asked = queries_of(stored).select(*names, along(rows).alias("i"), spread[1].alias("j"))

    def each(vectors_: pa.Table, queries: pa.Table) -> pa.Table:
        best: dict[tuple[int, int, int], list] = {}
        asked_ = []
        for row in queries.to_pylist():
            ids, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["asked"], np.int64)
            asked_ += [((row["block"], int(p), int(i)), q) for i, p, q in zip(ids, at, widened(row["entries"]).reshape(len(ids), row["width"]), strict=True)]
        for row in vectors_.to_pylist() if asked_ else ():
            ids = np.frombuffer(row["ids"], np.int64)
            index = Index(ids, widened(row["entries"]).reshape(len(ids), row["width"]))
            for name, q in asked_:
                best.setdefault(name, []).append(index.search(q, k, name[1] if name[0] == row["block"] else None))
        out: list[tuple] = []
        for (block, place, query_id), found in best.items():
            ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            top = np.lexsort((ids, -scores))[:k]
            out += [(block, place, query_id, i, s) for i, s in zip(ids[top].tolist(), scores[top].tolist(), strict=True)]
        columns_ = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("block", "place", "query_id", "vec_id", "score"), columns_, strict=True)})

    best = whole.groupBy("width", "i", "j").cogroup(asked.groupBy("width", "i", "j")).applyInArrow(each, "block long, place long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP2_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.rid <> q.rid AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
