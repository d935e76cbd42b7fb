"""Best-fit packing by linear grouping.

A document's ids end with id 2; documents of more than `capacity` ids are cut into pieces of `capacity`, the first of
which may be shorter. Lengths are integers up to the capacity, so the whole packing problem is a histogram of `capacity`
numbers, whatever the size of the corpus: it is solved on the driver, and the solution, runs of equal bins, is a table
bounded by the capacity too. Documents find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions, texts, written

CAPACITY = 1024
END = 2
#: Words whose ids a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers.

    The pre-tokeniser splits at every single blank between two words and on both sides of a single newline, so the ids of a
    text are its parts' ids one after another, and most parts have been seen before. Texts with runs of white space, or
    with the separator used here, are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str, whole_path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(whole_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.runs = re.compile(r"\s\s").search

    def whole(self, text: str) -> bytes:
        return np.asarray(self.encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # such a string is one id there
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.runs(text) or "\0" in text:
            return self.whole(text)
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = b""
        try:
            return b"".join([known[x] for x in parts])
        except KeyError:
            for x in parts:
                if x not in known:
                    known[x] = self.whole(x)
            return b"".join([known[x] for x in parts])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The ids of `tokenizers` for the vocabulary file `name`.json; the same vocabulary as ranks gives the same ids."""
    if name not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[name] = Encoder(public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path(f"{name}.json"))
    return _ENCODERS[name]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or full ones after a first that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """The pieces of every document's ids. A null text is empty and has the end id alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(vocabulary), np.asarray([END], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(ids_of(text.as_py()) + end)
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(each, PIECES)


# The plan: runs of bins, as (bins, free, slots); a slot (length, rank) holds in each bin of the run the next piece of its length.


def patterns(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(bins, pieces of each size in a bin): the configurations of a linear programme over few sizes, rounded up and trimmed.

    Column generation: the programme's prices go into a knapsack whose best filling is the next configuration.
    """
    m = len(sizes)
    basis = np.diag([float(min(capacity // s, max(1, n))) for s, n in zip(sizes, counts, strict=True)])
    demand = np.asarray(counts, float)
    width, most = np.asarray(sizes), capacity // min(sizes)
    reach = np.arange(capacity + 1)[None, :] - width[:, None]
    for _ in range(20 * m):
        prices = np.linalg.solve(basis.T, np.ones(m))
        best, choices = np.zeros(capacity + 1), []
        for _ in range(most):  # one more piece in the bin; -1: none
            gain = np.where(reach >= 0, best[np.maximum(reach, 0)] + prices[:, None], -1.0)
            which = np.argmax(gain, axis=0)
            value = gain[which, np.arange(capacity + 1)]
            choices.append(np.where(value > best + 1e-12, which, -1))
            best = np.maximum(best, value)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        for which in reversed(choices):
            if which[c] >= 0:
                column[which[c]] += 1
                c -= sizes[which[c]]
        level, along = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(along > 1e-9, np.maximum(level, 0) / np.where(along > 1e-9, along, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    level = np.linalg.solve(basis, demand)
    return sorted(((int(np.floor(max(x, 0) + 1e-9)), tuple(int(round(v)) for v in basis[:, k])) for k, x in enumerate(level)), reverse=True)


class Packer:
    """Packs a histogram of lengths into runs of bins."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 128, small: int | None = None) -> None:
        self.capacity, self.left = capacity, Counter({n: c for n, c in histogram.items() if c > 0})
        self.used: Counter = Counter()
        self.spare: Counter = Counter()
        self.runs: list[list] = []
        large = sorted((n for n in self.left if n > (capacity // 8 if small is None else small)), reverse=True)
        total = sum(self.left[n] for n in large)
        if total:
            self.grouped(large, total, min(groups, total))
        self.best_fit()

    def take(self, n: int, count: int) -> tuple[int, int]:
        slot = (n, self.used[n])
        self.used[n] += count
        self.left[n] -= count
        return slot

    def grouped(self, large: list[int], total: int, groups: int) -> None:
        """Equal numbers of long pieces in each group, all rounded up to the group's longest; the real ones take the places."""
        share, members, at = -(-total // groups), [[]], 0
        for n in large:  # each group: [length, pieces], longest first
            count = self.left[n]
            while count:
                if at == share:
                    members.append([])
                    at = 0
                some = min(count, share - at)
                members[-1].append([n, some])
                at, count = at + some, count - some
        merged: dict[int, list] = {}
        for group in members:
            merged.setdefault(group[0][0], []).extend(group)
        sizes = list(merged)
        queues = [merged[s] for s in sizes]
        for bins, pattern in patterns(sizes, [sum(c for _, c in q) for q in queues], self.capacity):
            wanted = [k for k, copies in sorted(enumerate(pattern), key=lambda x: -sizes[x[0]]) for _ in range(copies)]
            while bins and wanted:
                slots, free = [], self.capacity
                for k in wanted[:-1]:
                    while queues[k] and not self.left[queues[k][0][0]]:
                        queues[k].pop(0)
                    if not queues[k]:
                        break
                    slots.append(queues[k][0][0])
                    free -= slots[-1]
                # pieces are shorter than their group's length, so that the last one may be longer than its own
                last = self.longest(free, slots)
                if len(slots) < len(wanted) - 1 or last is None:
                    break
                need = Counter([*slots, last])
                some = min([bins, *(self.left[n] // c for n, c in need.items())])
                if some == 0:  # fewer of a length than the bin has: the next ones of its group stand in
                    for n, c in need.items():
                        if self.left[n] < c:
                            self.spare[n] = self.left.pop(n)
                    continue
                self.runs.append([some, free - last, [self.take(n, some) for n in (*slots, last)]])
                bins -= some
        for n, c in self.spare.items():
            self.left[n] += c

    def longest(self, room: int, others: list[int]) -> int | None:
        """The longest length that is left, besides the others', and fits."""
        taken = Counter(others)
        return next((n for n in range(room, 0, -1) if self.left[n] > taken[n]), None)

    def best_fit(self) -> None:
        """What is left, longest first, each into the fullest bin with room for it, or a new one."""
        by_free: dict[int, list] = {}
        heap_free: list[int] = []

        def put(run: list) -> None:
            if run[1] not in by_free:
                by_free[run[1]] = []
                heapq.heappush(heap_free, run[1])
            by_free[run[1]].append(run)

        runs, self.runs = self.runs, []
        for run in runs:
            put(run)
        for n in sorted((n for n, c in self.left.items() if c > 0), reverse=True):
            while self.left[n] > 0:
                free = min((f for f, rs in by_free.items() if f >= n and rs), default=None)
                if free is None:
                    per = min(self.capacity // n, self.left[n])
                    bins = self.left[n] // per
                    put([bins, self.capacity - per * n, [self.take(n, bins) for _ in range(per)]])
                    continue
                run = by_free[free].pop()
                per = min(free // n, self.left[n])
                some = min(run[0], self.left[n] // per)
                if some < run[0]:  # the run's later bins stay as they are: their slots begin `some` pieces on
                    by_free[free].append([run[0] - some, free, [(m, r + some) for m, r in run[2]]])
                put([some, free - per * n, run[2] + [self.take(n, some) for _ in range(per)]])
        self.runs = [run for rs in by_free.values() for run in rs]

    def table(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, pieces, first sequence, offset) for each slot of each run."""
        rows, sequence = [], 0
        for bins, _, slots in self.runs:
            at = 0
            for n, rank in slots:
                rows.append((n, rank, bins, sequence, at))
                at += n
            sequence += bins
        return rows


def ranked(df: DataFrame, capacity: int) -> DataFrame:
    """Adds `rank`, 0 and on among rows of one length. A length may hold any share of the rows, so ranks are given within (length, salt) and moved on by the salts before."""
    salts = max(8, 2 * partitions(df.sparkSession))
    df = df.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = df.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
    inside = df.withColumn("inside", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    joined = inside.join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
    return joined.withColumn("rank", F.col("before") + F.col("inside")).drop("salt", "before", "inside")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Every piece with its sequence and its place there; sequences have no gaps and at most `capacity` ids.

    No documents: no rows. Repeated rows are packed one by one. Which of two pieces of one length takes which place
    follows from their ids and crc32 alone.
    """
    spark = docs.sparkSession
    cuts = written(pieces(docs, capacity, vocabulary), "pieces")
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    plan = Packer(histogram, capacity).table()
    by_length: dict[int, list] = {}
    for n, rank, bins, sequence, at in plan:
        by_length.setdefault(n, []).append((rank, sequence, at))
    held = {n: tuple(np.asarray(x, np.int64) for x in zip(*sorted(rows), strict=True)) for n, rows in by_length.items()}
    sent = spark.sparkContext.broadcast(held)  # runs of bins: bounded by the capacity, not by the documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                first, where, at = held[int(n)]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = where[k] + rank[mine] - first[k], at[k]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(cuts, capacity).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
