"""Repeated substrings by enhanced suffix arrays with common-prefix intervals, over a whole corpus.

Which bytes are repeated: every window of LENGTH bytes has an anchor: its K-gram of the least hash, the leftmost of equals.
Equal windows have equal anchors at equal places, so windows meet their likes by their anchors, of which there is one in
about 80 bytes. A context is the bytes of all windows of one occurrence of an anchor. Anchors that stand once are dropped;
contexts that are equal as a whole (in two 64-bit hashes, of the anchor and of the context) are one entry with a number of
copies. The different contexts of an anchor go to one task, which

* sorts the suffixes at their window starts (an order in which equal prefixes are neighbours), with common-prefix lengths
  taken from the bytes;
* scans them with a stack: each interval of the common-prefix tree of LENGTH bytes or more, with all its occurrences;
* keeps those whose occurrences differ in the byte before them or stand at a context's edge.

An anchor with more than WIDE different contexts, such as one at the edge of a passage that a third of all texts hold, is
never gathered: its windows' hashes are counted in even parts (`counted`), which finds the same bytes up to 64-bit hashes.

Which strings are repeated where (`Repeats.groups`): the repeated bytes make up runs, a run ends where no window is repeated.
Equal runs, which exact copies and frequent passages consist of, are one entry, by their bytes. Only suffixes whose first
window has several bytes before it, over all runs, can begin a maximal repeat; they meet by that window, and the stack scan
over their sorted array gives each maximal repeat at its full length. Entries are joined with their places at the end, so
that all occurrences are listed however many there are.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, encoded, identity, mix, partitions, written

LENGTH = 200
K = 40
WIDE = 128
#: Bytes of a text that are hashed at a time; a longer text is cut into parts that overlap by a window.
PART = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PART + 4 * LENGTH)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """64-bit hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))

    def every(self, size: int) -> np.ndarray:
        """Of all substrings of one size, in order."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size * _BASE % (1 << 64)))


def anchors(rows: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, context hash, anchor's place, first and last window start) of all anchors of some texts."""
    parts = [(d, at, r[at : at + PART + length - 1]) for d, r in enumerate(rows) for at in range(0, max(1, len(r) - length + 1), PART) if len(r) >= length]
    found = [[np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64)]]
    for group in _grouped(parts):
        data = np.frombuffer(b"".join(p for *_, p in group), np.uint8)
        hashes = Hashes(data)
        bits = np.uint64(23)
        place = np.arange(len(data) - k + 1, dtype=np.uint64)
        least = ((hashes.every(k) >> bits) << bits) | place
        span, width = length - k + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        size = np.fromiter((len(p) for *_, p in group), np.int64, len(group))
        first = np.cumsum(size) - size
        many = size - length + 1
        start = np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)
        at = (least[start] & np.uint64((1 << 23) - 1)).astype(np.int64)
        part = np.repeat(np.arange(len(group)), many)
        lead = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]))))
        last = np.append(lead[1:], len(at)) - 1
        a, lo, hi, p = at[lead], start[lead], start[last], part[lead]
        shift = np.asarray([s for _, s, _ in group])[p] - first[p]
        found.append([np.asarray([d for d, *_ in group])[p], hashes.of(a, a + k), hashes.of(lo, hi + length), a + shift, lo + shift, hi + shift])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _grouped(parts: list) -> Iterator[list]:
    group, size = [], 0
    for part in parts:
        if group and size + len(part[2]) > PART + LENGTH:
            yield group
            group, size = [], 0
        group.append(part)
        size += len(part[2])
    if group:
        yield group


def intervals(common: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats among sorted suffixes: a stack scan over the common-prefix interval tree.

    common[i]: bytes shared by suffixes i - 1 and i. before[i]: the byte before suffix i, negative and different for each
    where there is none or it is not known. An interval counts if its members have more than one kind of byte before them.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []  # length, first, the one byte before all members or None for several

    def joined(a: int | None, b: int | None) -> int | None:
        return a if a == b else None

    n = len(before)
    for i in range(1, n + 1):
        depth = int(common[i]) if i < n else 0
        first, kind = i - 1, int(before[i - 1])
        while stack and stack[-1][0] > depth:
            length, first_, kind_ = stack.pop()
            kind = joined(kind, kind_)
            first = first_
            if kind is None:
                out.append((length, first, i - 1))
        if stack and stack[-1][0] == depth:
            stack[-1][2] = joined(stack[-1][2], kind)
        elif depth >= least:
            stack.append([depth, first, kind])
    return out


class SuffixArray:
    """The sorted suffixes, at window starts, of some contexts (bytes, whether the first is the byte before the first window)."""

    def __init__(self, contexts: list[bytes], edge: np.ndarray, length: int = LENGTH) -> None:
        self.length = length
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        self.data = np.frombuffer(b"".join(contexts) + bytes(length), np.uint8)
        first = np.cumsum(size) - size + edge
        self.end = np.cumsum(size)
        many = self.end - first - length + 1
        of = np.repeat(np.arange(len(contexts)), many)
        start = np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)
        name = Hashes(self.data).every(length)[start]
        order = np.argsort(name, kind="stable")
        name, start, of = name[order], start[order], of[order]
        same = name[1:] == name[:-1] if len(name) else np.zeros(0, bool)
        keep = np.zeros(len(name), bool)
        keep[1:] |= same
        keep[:-1] |= same
        name, start, of = name[keep], start[keep], of[keep]
        # what precedes: the byte, or a number of its own where a context begins
        inside = start > first[of]
        before = np.where(inside, self.data[np.maximum(start - 1, 0)].astype(np.int64), -1 - np.arange(len(start)))
        # runs of one name all of whose members have one byte before them are parts of earlier ones
        lead = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))) if len(name) else np.zeros(0, np.int64)
        if len(lead):
            mixed = np.maximum.reduceat(before, lead) != np.minimum.reduceat(before, lead)
            go = np.repeat(mixed, np.diff(np.append(lead, len(name))))
            name, start, of, before = name[go], start[go], of[go], before[go]
        self.name, self.start, self.of, self.before = name, start, of, before

    def repeats(self) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places in the data) of each maximal repeat, with all its occurrences."""
        lead = np.flatnonzero(np.concatenate(([True], self.name[1:] != self.name[:-1]))) if len(self.name) else np.zeros(0, np.int64)
        for a, b in zip(lead.tolist(), [*lead[1:].tolist(), len(self.name)], strict=True) if len(lead) else ():
            start = self.start[a:b]
            room = self.end[self.of[a:b]] - start
            suffixes = [self.data[s : s + r].tobytes() for s, r in zip(start.tolist(), room.tolist(), strict=True)]
            order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
            common = np.zeros(len(order), np.int64)
            for i in range(1, len(order)):
                common[i] = shared(suffixes[order[i - 1]], suffixes[order[i]])
            before, start = self.before[a:b][order], start[order]
            for length, first, last in intervals(common, before, self.length):
                yield length, start[first : last + 1]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, from the bytes."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def with_rows(docs: DataFrame) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select(*identity(), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def occurrences(docs: DataFrame, length: int, k: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            of, anchor, context, _, lo, hi = anchors(encoded(part.column("text")), length, k)
            doc, row = (np.asarray(part.column(c))[of] if len(of) else np.zeros(0, np.int64) for c in ("doc", "row"))
            columns = [anchor.view(np.int64), context.view(np.int64), doc, row, lo, (hi - lo).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "context", "doc", "row", "lo", "more"])

    return docs.select("doc", "row", "text").mapInArrow(each, "anchor long, context long, doc long, row long, lo long, more int")


def with_frequent_spread(rows: DataFrame, keys: DataFrame, key: str, n: str) -> DataFrame:
    """The rows whose key is in `keys` (key, n: how many rows have it). Keys with more than a FEWth of all rows, of which there are fewer than FEW, are spread over SALTS tasks."""
    total = keys.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = [r[0] for r in keys.where(F.col(n) > F.lit(max(1, total // FEW))).select(key).limit(FEW).collect()]  # fewer than FEW by that bound
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64("doc", "row", "lo"), F.lit(SALTS))).otherwise(F.lit(0)) if hot else F.lit(0)
    spread = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    every = keys.select(key, F.explode(spread.cast("array<long>")).alias("salt"))
    return rows.withColumn("salt", salt.cast("long")).join(every, [key, "salt"], "left_semi").drop("salt")


CONTEXT = "anchor long, context long, copies long, wide boolean, doc long, row long, lo long, edge int, bytes binary"


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts (anchor, context, copies, wide, row, lo, more), with the byte before them if there is one (edge 1)."""
    lists = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "context", "copies", "wide", "lo", "more")).alias("wanted"))  # as many as the text's anchors
    joined = docs.select("doc", "row", "text").join(lists, ["doc", "row"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("copies", pa.int64()), ("wide", pa.bool_()), ("doc", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("edge", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            for k in range(batch.num_rows):
                doc, row, text, some = *(batch.column(c)[k].as_py() for c in range(3)), batch.column(3)[k].values
                cols = {f.name: some.field(i) for i, f in enumerate(some.type)}
                lo, more = cols["lo"].to_pylist(), cols["more"].to_pylist()
                edge = [1 if a else 0 for a in lo]
                body = [text[a - e : a + m + length] for a, e, m in zip(lo, edge, more, strict=True)]
                yield pa.RecordBatch.from_arrays([cols["anchor"], cols["context"], cols["copies"], cols["wide"], pa.array([doc] * len(lo), pa.int64()), pa.array([row] * len(lo), pa.int64()), cols["lo"], pa.array(edge, pa.int32()), pa.array(body, pa.binary())], schema=schema)

    return joined.mapInArrow(each, CONTEXT)


SPAN = "doc long, row long, start long, end long"
#: A key is frequent with more than this share of all rows, and then spread over so many tasks.
FEW, SALTS = 256, 64


def sorted_spans(found: DataFrame, length: int) -> DataFrame:
    """SPAN of the occurrences, in the given contexts, of each interval of their anchors' common-prefix trees."""
    buckets = 4 * partitions(found.sparkSession)

    def each(group: pa.Table) -> pa.Table:
        group = group.sort_by([("anchor", "ascending"), ("context", "ascending")])
        columns: dict[str, list] = {c: [np.zeros(0, np.int64)] for c in ("doc", "row", "start", "end")}
        doc, row, lo = (np.asarray(group.column(c)) for c in ("doc", "row", "lo"))
        edge, body = np.asarray(group.column("edge")).astype(np.int64), group.column("bytes").to_pylist()
        at = 0
        while at < len(body):  # some anchors at a time
            anchor, to = group.column("anchor"), min(len(body), at + 4096)
            while to < len(body) and anchor[to].as_py() == anchor[to - 1].as_py():
                to += 1
            array = SuffixArray(body[at:to], edge[at:to], length)
            begin = array.end - np.fromiter(map(len, body[at:to]), np.int64, to - at)
            for size, places in array.repeats():
                of = np.searchsorted(array.end, places, side="right")
                start = lo[at:to][of] + places - begin[of] - edge[at:to][of]
                for name, values in (("doc", doc[at:to][of]), ("row", row[at:to][of]), ("start", start), ("end", start + size)):
                    columns[name].append(values)
            at = to
        return pa.table({c: np.concatenate(v) for c, v in columns.items()})

    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").applyInArrow(each, SPAN)


def asked(rows: DataFrame, cut: Callable, judge: Callable, give: Callable, out: str, limit: int = 4 << 20) -> DataFrame:
    """Asks even parts of the hash values about hashes. `cut` makes of some rows (ascending hashes, a note of 16 bits for each, anything); `judge` answers a byte for each of a part's hashes and notes, which come from all rows; `give` makes the resulting table of anything and the answers in order."""
    buckets = partitions(rows.sparkSession)
    edges = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64)
    fields = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("notes", pa.binary()), ("rest", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for part in chunked(batches, "bytes", limit):
            hashes, notes, rest = cut(part)
            name, number = (TaskContext.get().partitionId() << 32) + number, number + 1
            at = np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))
            found = [{"bucket": b, "batch": name, "hashes": hashes[x:y].tobytes(), "notes": notes[x:y].astype(np.int16).tobytes()} for b, (x, y) in enumerate(zip(at, at[1:], strict=False)) if x < y]
            found.append({"bucket": -1 - number % buckets, "batch": name, "rest": pickle.dumps(rest)})
            yield from pa.Table.from_pylist(found, fields).to_batches()

    def add(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return group.select(["batch", "bucket", "rest"])
        hashes = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()]
        said = judge(np.concatenate(hashes), np.frombuffer(b"".join(group.column("notes").to_pylist()), np.int16)).astype(np.uint8)
        edge = np.cumsum([0, *map(len, hashes)])
        return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "rest": pa.array([said[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())})

    def back(group: pa.Table) -> pa.Table:
        found = sorted(zip(group.column("bucket").to_pylist(), group.column("rest").to_pylist(), strict=True))
        return give(pickle.loads(found[0][1]), np.frombuffer(b"".join(x for _, x in found[1:]), np.uint8))  # noqa: S301 - what `send` wrote

    sent = rows.mapInArrow(send, "bucket int, batch long, hashes binary, notes binary, rest binary")
    return sent.groupBy("bucket").applyInArrow(add, "batch long, bucket int, rest binary").groupBy("batch").applyInArrow(back, out)


def counted(found: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows in contexts of anchors that have very many: windows' hashes are added up in parts of even size.

    A batch of contexts sends each part its different hashes once, the part answers which of them stand elsewhere too.
    """

    def cut(part: pa.Table) -> tuple:
        body, edge, copies = part.column("bytes").to_pylist(), np.asarray(part.column("edge")).astype(np.int64), np.asarray(part.column("copies"))
        size = np.fromiter(map(len, body), np.int64, len(body))
        first, end = np.cumsum(size) - size + edge, np.cumsum(size)
        windows = end - first - length + 1
        start = np.arange(int(windows.sum())) + np.repeat(first - (np.cumsum(windows) - windows), windows)
        hashes, place = np.unique(Hashes(np.frombuffer(b"".join(body), np.uint8)).every(length)[start], return_inverse=True)
        many = np.minimum(np.bincount(place, np.repeat(copies, windows)), 255)
        meta = np.column_stack([np.asarray(part.column(c)) for c in ("doc", "row", "lo")] + [windows]).astype(np.int64)
        return hashes, many, (meta, place.astype(np.int32))

    def judge(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
        _, at = np.unique(hashes, return_inverse=True)
        return (np.bincount(at, many) > 1)[at]

    def give(rest: tuple, known: np.ndarray) -> pa.Table:
        meta, place = rest
        hit = known.astype(bool)[place]
        of = np.repeat(np.arange(len(meta)), meta[:, 3])
        at = np.arange(len(of)) - np.repeat(np.cumsum(meta[:, 3]) - meta[:, 3], meta[:, 3]) + meta[of, 2]
        mine = np.flatnonzero(hit)
        of, at = of[mine], at[mine]
        lead = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])))) if len(at) else np.zeros(0, np.int64)
        last = np.append(lead[1:], len(at)) - 1 if len(lead) else lead
        return pa.table({"doc": meta[of[lead], 0], "row": meta[of[lead], 1], "start": at[lead], "end": at[last] + length})

    return asked(found.select("doc", "row", "lo", "edge", "copies", "bytes"), cut, judge, give, SPAN)


def several_before(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of each window whether over all of its equals there are several bytes before it, or none (negative) somewhere."""
    _, at = np.unique(hashes, return_inverse=True)
    low, high = np.full(int(at.max(initial=-1)) + 1, 1000, np.int16), np.full(int(at.max(initial=-1)) + 1, -1000, np.int16)
    np.minimum.at(low, at, before)
    np.maximum.at(high, at, before)
    return ((low < 0) | (low != high))[at]


STARTS = "window long, entry long, at int, before int, n long, bytes binary"


def starts(entries: DataFrame, length: int) -> DataFrame:
    """Of different runs (entry, n, bytes) the suffixes that a maximal repeat can begin with, STARTS: those whose first window has several bytes before it, over all runs, or begins a run. A run's first byte has none before it that is repeated with it."""

    def cut(part: pa.Table) -> tuple:
        body = part.column("bytes").to_pylist()
        size = np.fromiter(map(len, body), np.int64, len(body))
        data = np.frombuffer(b"".join(body), np.uint8)
        first, windows = np.cumsum(size) - size, size - length + 1
        at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        place = at + np.repeat(first, windows)
        hashes = Hashes(data).every(length)[place]
        before = np.where(at > 0, data[np.maximum(place - 1, 0)].astype(np.int16), -1)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], before[order], (part.column("entry").to_pylist(), part.column("n").to_pylist(), body, order, hashes, before)

    def give(rest: tuple, known: np.ndarray) -> pa.Table:
        entry, n, body, order, hashes, before = rest
        good = np.zeros(len(order), bool)
        good[order] = known.astype(bool)
        windows = np.fromiter(map(len, body), np.int64, len(body)) - length + 1
        of = np.repeat(np.arange(len(body)), windows)
        at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        mine = np.flatnonzero(good)
        kinds = {"window": pa.int64(), "entry": pa.int64(), "at": pa.int32(), "before": pa.int32(), "n": pa.int64(), "bytes": pa.binary()}
        columns = {
            "window": hashes[mine].view(np.int64), "entry": [entry[k] for k in of[mine]], "at": at[mine], "before": before[mine], "n": [n[k] for k in of[mine]], "bytes": [body[k][a:] for k, a in zip(of[mine].tolist(), at[mine].tolist(), strict=True)],
        }
        return pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()})

    return asked(entries.select("entry", "n", "bytes"), cut, several_before, give, STARTS, 1 << 18)  # each start brings the rest of its run


def maximal_repeats(suffixes: DataFrame, length: int) -> DataFrame:
    """repeat (a hash of the string), length, entry, at: the maximal repeats among suffixes (STARTS) and where they stand in the different runs. A run that is there several times is a repeat of its own."""
    buckets = 4 * partitions(suffixes.sparkSession)

    def each(group: pa.Table) -> pa.Table:
        windows = np.asarray(group.column("window"))
        order = np.argsort(windows, kind="stable")
        windows, group = windows[order], group.take(order)
        entry, at, before = (group.column(c).to_pylist() for c in ("entry", "at", "before"))
        n, body = group.column("n").to_pylist(), group.column("bytes").to_pylist()
        lead = np.flatnonzero(np.concatenate(([True], windows[1:] != windows[:-1]))).tolist()
        out: list[tuple] = []
        for a, b in zip(lead, [*lead[1:], len(body)], strict=True):
            # a run that is there several times is in the array twice, its first suffix without a common byte before it
            members = sorted((k for k in range(a, b) for _ in range(min(n[k], 2))), key=body.__getitem__)
            common = np.asarray([0, *(shared(body[x], body[y]) for x, y in zip(members, members[1:], strict=False))])
            marks = np.asarray([before[k] if before[k] >= 0 else -1 - i for i, k in enumerate(members)])
            for size, first, last in intervals(common, marks, length):
                some = sorted(set(members[first : last + 1]))
                name = int.from_bytes(hashlib.blake2b(body[some[0]][:size], digest_size=8).digest(), "little", signed=True)
                out += [(name, size, entry[k], at[k]) for k in some]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("repeat", "length", "entry", "at"), columns, strict=True)})

    keyed = suffixes.withColumn("bucket", F.pmod(F.xxhash64("window"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").applyInArrow(each, "repeat long, length long, entry long, at long")

KINDS = "anchor long, kind long, entry long, lo long, more int"


def run_kinds(entries: DataFrame, length: int, k: int) -> DataFrame:
    """KINDS of the anchors in different runs (entry, bytes): a kind is a context with the byte before it, or none where it begins the run."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, "bytes"):
            body = part.column("bytes").to_pylist()
            of, anchor, context, _, lo, hi = anchors(body, length, k)
            size = np.fromiter(map(len, body), np.int64, len(body))
            place = (np.cumsum(size) - size)[of] + lo
            before = np.where(lo > 0, np.frombuffer(b"".join(body) + b" ", np.uint8)[np.maximum(place - 1, 0)].astype(np.int64), 256)
            kind = mix(context + (before + 1).astype(np.uint64) * np.uint64(_BASE))
            columns = [anchor.view(np.int64), kind.view(np.int64), np.asarray(part.column("entry"))[of], lo, (hi - lo).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "kind", "entry", "lo", "more"])

    return entries.select("entry", "bytes").mapInArrow(each, KINDS)


def starts_of_kinds(found: DataFrame, length: int) -> DataFrame:
    """anchor, kind, window, off, before: the windows of the given kinds (as of `contexts`) that have several bytes before them or begin a run. Equal windows have equal anchors, so that all kinds of an anchor know all that stands before its windows."""

    def windows(body: list[bytes], edge: np.ndarray) -> tuple[np.ndarray, ...]:
        size = np.fromiter(map(len, body), np.int64, len(body))
        first, many = np.cumsum(size) - size + edge, size - edge - length + 1
        of = np.repeat(np.arange(len(body)), many)
        off = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        place = off + first[of]
        data = np.frombuffer(b"".join(body), np.uint8)
        hashes = Hashes(data).every(length)[place]
        before = np.where((off > 0) | (edge[of] > 0), data[np.maximum(place - 1, 0)].astype(np.int16), -1)
        return of, off, hashes, before, np.argsort(hashes, kind="stable")

    def cut(part: pa.Table) -> tuple:
        body, edge = part.column("bytes").to_pylist(), np.asarray(part.column("edge")).astype(np.int64)
        _, _, hashes, before, order = windows(body, edge)
        return hashes[order], before[order], (np.asarray(part.column("anchor")), np.asarray(part.column("context")), body, edge)

    def give(rest: tuple, known: np.ndarray) -> pa.Table:
        anchor, kind, body, edge = rest
        of, off, hashes, before, order = windows(body, edge)
        mine = np.sort(order[known.astype(bool)])
        return pa.table({"anchor": anchor[of[mine]], "kind": kind[of[mine]], "window": hashes[mine].view(np.int64), "off": off[mine].astype(np.int32), "before": before[mine].astype(np.int32)})

    return asked(found.select("anchor", "context", "edge", "bytes"), cut, several_before, give, "anchor long, kind long, window long, off int, before int", 1 << 20)


def dealt(members: DataFrame) -> DataFrame:
    """The starts of each run (entry, n, bytes, starts) by parts of the windows: a part gets the bytes of a run once, from the first of its starts on."""
    buckets = 4 * partitions(members.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, starts = batch.column(2)[k].as_py(), batch.column(3)[k].values
                bucket = (np.asarray(starts.field("window")).view(np.uint64) % np.uint64(buckets)).astype(np.int32)
                at = np.asarray(starts.field("at")).astype(np.int64)
                order = np.lexsort((at, bucket))
                lead = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
                some = len(lead)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order][lead], pa.int32()), pa.array([batch.column(1)[k].as_py()] * some, pa.int64()), pa.array(at[order][lead], pa.int64()), pa.array([text[a:] for a in at[order][lead].tolist()], pa.binary()), pa.ListArray.from_arrays(pa.array([*lead, len(order)], pa.int32()), starts.take(pa.array(order)))],
                    names=["bucket", "n", "from", "bytes", "starts"],
                )

    kind = members.schema["starts"].dataType.simpleString()
    return members.select("entry", "n", "bytes", "starts").mapInArrow(each, f"bucket int, n long, from long, bytes binary, starts {kind}")


def suffix_order(data: bytes, start: list[int], end: list[int], step: int = 1024) -> list[int]:
    """The suffixes data[start:end] in order, looking at so many bytes of each at a time."""
    out: list[int] = []
    todo = [(list(range(len(start))), 0)]
    while todo:
        some, skip = todo.pop()
        if len(some) == 1:
            out += some
            continue
        key = {k: data[start[k] + skip : min(end[k], start[k] + skip + step)] for k in some}
        some.sort(key=key.__getitem__)
        lead = [i for i in range(len(some)) if not i or key[some[i]] != key[some[i - 1]]]
        for a, b in reversed(list(zip(lead, [*lead[1:], len(some)], strict=True))):
            if len(key[some[a]]) < step:  # equal to their ends
                todo += [([k], 0) for k in reversed(some[a:b])]
            else:
                todo.append((some[a:b], skip + step))
    return out


def extremes(values: np.ndarray, first: np.ndarray, last: np.ndarray, best: np.ufunc) -> np.ndarray:
    """best of values[first : last + 1] of each pair, by a table of stretches of powers of two."""
    level, out, width = values, np.zeros(len(first), values.dtype), last - first + 1
    size = 1
    while len(first) and size <= int(width.max()):
        mine = (width >= size) & (width < 2 * size)
        out[mine] = best(level[first[mine]], level[last[mine] - size + 1])
        level = best(level[: len(level) - size], level[size:]) if len(level) > size else level
        size *= 2
    return out


SUMMARY = "length long, places long, first_doc_id long, first_start long, last_doc_id long, last_start long, sum long"


def summed_repeats(parts: DataFrame, length: int) -> DataFrame:
    """SUMMARY of each maximal repeat: the sums over the intervals of the sorted suffixes, whose members are never listed, as a periodic run has as many as the square of its length."""

    def each(group: pa.Table) -> pa.Table:
        body, n, base = group.column("bytes").to_pylist(), np.asarray(group.column("n")), np.asarray(group.column("from"))
        size = np.fromiter(map(len, body), np.int64, len(body))
        lists = pa.concat_arrays(group.column("starts").chunks)
        of, starts = np.repeat(np.arange(len(body)), np.asarray(lists.value_lengths())), lists.flatten()
        col = {name: np.asarray(starts.field(name)) for name in ("window", "at", "before", "places", "first_doc", "first_start", "last_doc", "last_start", "sum")}
        end = np.cumsum(size)[of]
        start = end - size[of] + col["at"] - base[of]
        order = np.argsort(col["window"], kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(col["window"][order]) != 0, [True]))).tolist()
        data, out = b"".join(body), [np.zeros((0, 7), np.int64)]
        for a, b in zip(edges, edges[1:], strict=False):
            # a run that is there several times is in the array twice, its first suffix without a common byte before it
            mine = np.repeat(order[a:b], np.minimum(n[of[order[a:b]]], 2))
            once = np.concatenate(([True], mine[1:] != mine[:-1]))
            x, y = start[mine].tolist(), end[mine].tolist()
            sort = suffix_order(data, x, y)
            common = np.asarray([0, *(shared(data[x[i] : y[i]], data[x[j] : y[j]]) for i, j in zip(sort, sort[1:], strict=False))])
            mine, once = mine[sort], once[sort]
            before = col["before"][mine]
            found = np.asarray(intervals(common, np.where(before >= 0, before, -1 - np.arange(len(mine))), length), np.int64).reshape(-1, 3)
            long, first, last = found.T
            sums = [np.concatenate(([0], np.cumsum(col[c][mine] * once))) for c in ("places", "sum")]
            columns = [long, sums[0][last + 1] - sums[0][first]]
            for side, best in (("first", np.minimum), ("last", np.maximum)):
                pair = np.lexsort((col[f"{side}_start"][mine], col[f"{side}_doc"][mine]))
                rank = np.empty(len(mine), np.int64)
                rank[pair] = np.arange(len(mine))
                at = mine[pair[extremes(rank, first, last, best)]]
                columns += [col[f"{side}_doc"][at], col[f"{side}_start"][at]]
            out.append(np.column_stack([*columns, sums[1][last + 1] - sums[1][first]]))
        names = [f.split()[0] for f in SUMMARY.split(", ")]
        return pa.table(dict(zip(names, np.concatenate(out).T.copy(), strict=True)))

    return parts.groupBy("bucket").applyInArrow(each, SUMMARY)


class Repeats:
    """The steps over a corpus; `docs` has doc, row and text (bytes)."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, k: int | None = None, wide: int = WIDE) -> None:
        k = min(K, length) if k is None else k
        every = occurrences(docs, length, k)
        again = written(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "repeated-anchors")
        self.found = written(with_frequent_spread(every, again, "anchor", "n"), "anchors")
        self.kinds = written(self.found.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "row", "lo", "more")).alias("at")), "contexts")
        several = written(self.kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several-contexts")
        wanted = self.kinds.join(several, "anchor").select("anchor", "context", "copies", (F.col("kinds") > wide).alias("wide"), "at.doc", "at.row", "at.lo", "at.more")
        self.contexts = written(contexts(docs, wanted, length), "context-bytes")
        self.docs, self.length, self.k = docs, length, k

    def spans(self) -> DataFrame:
        """SPAN of repeated bytes; spans of a row may overlap."""
        whole = self.found.join(self.kinds.where("copies > 1").select("anchor", "context"), ["anchor", "context"]).select("doc", "row", F.col("lo").alias("start"), (F.col("lo") + F.col("more") + self.length).alias("end"))
        return whole.union(sorted_spans(self.contexts.where("NOT wide"), self.length)).union(counted(self.contexts.where("wide"), self.length))

    def runs(self) -> DataFrame:
        """doc, row, start and bytes of each maximal stretch of repeated windows. Neighbouring stretches that only overlap, without a repeated window between them, are cut apart."""
        length = self.length
        spans = self.spans().groupBy("doc", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # bounded by a text's anchors

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
            for batch in batches:
                for doc, row, text, some in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    # windows begin from `start` to `end` - length; stretches of windows that touch are one
                    stretches = merged([(s["start"], s["end"] - length + 1) for s in some])
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(stretches), pa.int64()), pa.array([row] * len(stretches), pa.int64()), pa.array([a for a, _ in stretches], pa.int64()), pa.array([text[a : b + length - 1] for a, b in stretches], pa.binary())], schema=schema)

        return self.docs.select("doc", "row", "text").join(spans, ["doc", "row"]).mapInArrow(each, "doc long, row long, start long, bytes binary")

    def different(self) -> tuple[DataFrame, DataFrame]:
        """The different runs (entry, n, bytes), and where they stand (entry, doc, row, start)."""
        runs = written(self.runs(), "runs")
        entries = written(runs.groupBy("bytes").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("entry"), "n", "bytes"), "different-runs")
        return entries, written(runs.join(entries.select("entry", "bytes"), "bytes").select("entry", "doc", "row", "start"), "run-places")

    def groups(self) -> DataFrame:
        """repeat, length, doc, row, start: every maximal repeat of at least `length` bytes with all its occurrences, of equal rows once for each."""
        entries, places = self.different()
        found = maximal_repeats(starts(entries, self.length), self.length)
        return found.join(places, "entry").select("repeat", "length", "doc", "row", (F.col("start") + F.col("at")).alias("start"))

    def summary(self) -> DataFrame:
        """SUMMARY of every group of `groups`, from runs that are sent once to a part, and without a row for each occurrence."""
        entries, places = self.different()
        found = written(run_kinds(entries, self.length, self.k), "run-kinds")
        kinds = written(found.groupBy("anchor", "kind").agg(F.min(F.struct("entry", "lo", "more")).alias("one")), "kinds")
        several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("one.lo").alias("lo")).where("kinds > 1 OR lo = 0").select("anchor")
        one, whole = F.lit(1).cast("long"), F.lit(0).cast("long").alias("row")
        wanted = kinds.join(several, "anchor").select("anchor", F.col("kind").alias("context"), one.alias("copies"), F.lit(True).alias("wide"), F.col("one.entry").alias("doc"), whole, "one.lo", "one.more")
        known = written(starts_of_kinds(contexts(entries.select(F.col("entry").alias("doc"), whole, F.col("bytes").alias("text")), wanted, self.length), self.length), "kind-starts")
        begun = found.join(known, ["anchor", "kind"]).groupBy("entry").agg(F.collect_list(F.struct((F.col("lo") + F.col("off")).alias("at"), "window", "before")).alias("starts"))  # bounded by a run's length
        each = begun.join(places, "entry").select("entry", "doc", "start", F.explode("starts").alias("s"))
        place = F.struct("doc", (F.col("start") + F.col("s.at")).alias("start"))
        told = each.groupBy("entry", "s").agg(F.count("*").alias("places"), F.min(place).alias("first"), F.max(place).alias("last"), F.sum((F.col("doc") * 31 + F.col("start") + F.col("s.at")) % 1000003).alias("sum"))
        start = F.struct("s.*", "places", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("first", "last") for c in ("doc", "start")], "sum")
        members = told.groupBy("entry").agg(F.collect_list(start).alias("starts")).join(entries, "entry")
        return summed_repeats(dealt(members), self.length)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, length: int = LENGTH, k: int | None = None, wide: int = WIDE) -> DataFrame:
    """doc_id, text (bytes) and spans of every row of docs (doc, row, doc_id, text)."""
    found = Repeats(docs, length, k, wide).spans()
    spans = written(found.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")  # bounded by a text's anchors
    return docs.join(spans, ["doc", "row"], "left")


def digests(docs: DataFrame, length: int = LENGTH, k: int | None = None, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    A null text is empty; texts shorter than `length` have nothing to remove; rows repeated with id and text are each
    other's repeats; no rows, no rows.
    """
    joined = removed(with_rows(docs), length, k, wide)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for k_ in range(batch.num_rows):
                text, some = batch.column(1)[k_].as_py(), spans[k_].as_py()
                cut = merged([(s["start"], s["end"]) for s in some or ()])
                edge = [0, *(x for ab in cut for x in ab), len(text)]
                digest = hashlib.sha256()
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    digest.update(text[a:b])
                n_bytes.append(len(text))
                n_removed.append(sum(b - a for a, b in cut))
                n_spans.append(len(cut))
                kept.append(digest.hexdigest())
            numbers = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("doc_id", "text", "spans").mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Every window of 200 bytes, as 400 hexadecimal digits, counted as it is.
OP1_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, i, md5_number(substr(h, (2 * i + 1)::INT, 400)) AS k FROM (SELECT rid, h, unnest(range(0, n - 199)) AS i FROM t WHERE n >= 200)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS b FROM w SEMI JOIN r USING (k)),
s AS (SELECT rid, i, sum(b) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
runs AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS z FROM s GROUP BY ALL),
cut AS (SELECT rid, a, z, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS prev FROM runs),
per AS (SELECT rid, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, (2 * prev + 1)::INT, (2 * (a - prev))::INT), '' ORDER BY a) AS front, max(z) AS last FROM cut JOIN t USING (rid) GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(front || substr(h, (2 * last + 1)::INT), h))) AS kept_sha256
FROM t LEFT JOIN per USING (rid)
"""
