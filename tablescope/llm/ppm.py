"""Language-model scoring by partial matching: a byte-context trie with escapes and symbol exclusion.

The pretrained model's trie holds, for contexts of up to ORDER bytes, how often each byte or the end followed in all
training texts. A symbol seen n_s times in a context with n symbols of d kinds costs n_s / (n + d); else an escape of
d / (n + d) leads to the next shorter context, where symbols of the longer one are excluded; below the empty context all
of the 257 symbols left are equally likely. Counts cover all training texts and all their contexts; no task and no
broadcast holds more than a share of them that is bounded:

* a chunk of texts sends each different symbol in context, and each different word, once, with its count, to a bucket by
  the whole of its hash, so that no symbol in context or word is hot: it comes once from each chunk;
* a bucket adds up; words get their counts back at once, the different symbols in context go on to the bucket of their
  last three bytes, which has all that the contexts of orders three on need: at most 65,536 contexts of order 5 for each
  three bytes, however large the corpus. Counts of order 2, at most 65,536 contexts, are sent to all;
* the logs go back to the first buckets, from there to the chunks, which add them up for each text.

Texts longer than a chunk are cut at blanks into pieces that know the bytes before them, and their sums are added up.

`adaptive` scores one text with a trie that learns while it reads.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, Words, chunked, mix, partitions, texts, written

ORDER = 5
END = 256
SYMBOLS = 257
HELD_OUT = 2
#: Bytes of text for each bucket, as a power of two.
BUCKET_BITS = 26
#: Bytes of text that are counted at a time, and of a piece of a long text; a chunk has CHUNK times as many: what several texts share is sent once.
PIECE_BYTES, CHUNK = 1 << 20, 20
#: Parts in which the counts of order 2 are added up.
PARTS = 16


def symbols(rows: list[bytes], order: int = ORDER, before: list[bytes] | None = None, closes: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of `order` bytes as a number, symbol, text) of each symbol of some texts.

    A text begins after zero bytes, or after `before`, and closes with END unless `closes` says that more follows.
    """
    ends = np.ones(len(rows), bool) if closes is None else np.asarray(closes, bool)
    size = np.fromiter(map(len, rows), np.int64, len(rows)) + ends
    lead = [b"\0" * order] * len(rows) if before is None else before
    data = np.frombuffer(b"".join(x + r + (b"\0" if e else b"") for x, r, e in zip(lead, rows, ends.tolist(), strict=True)), np.uint8)
    text = np.repeat(np.arange(len(rows)), size)
    at = np.arange(len(text)) + (text + 1) * order
    symbol = data[at].astype(np.int32)
    symbol[(np.cumsum(size) - 1)[ends]] = END
    context = np.zeros(len(at), np.int64)
    for back in range(order, 0, -1):
        context = (context << 8) | data[at - back]
    return context, symbol, text


def remainder() -> F.Column:
    """crc32 of the id's text mod 7; a null id counts as the empty text, whose crc32 is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)).cast("int")


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text and its end under a trie that starts empty and learns each symbol after it is coded."""
    trie: dict[bytes, Counter] = defaultdict(Counter)
    total, held = 0.0, b"\0" * order + text
    for at in range(order, len(held) + 1):
        symbol, out, reach = (held[at] if at < len(held) else END), set(), 1.0
        for k in range(order, -1, -1):
            counts = {s: n for s, n in trie[held[at - k : at]].items() if s not in out}
            kinds, n = len(counts), sum(counts.values())
            left = SYMBOLS - len(out) > kinds
            if symbol in counts:
                reach *= counts[symbol] / (n + kinds if left else n)
                break
            if kinds:
                reach *= kinds / (n + kinds)
            out |= set(counts)
        else:
            reach /= SYMBOLS - len(out)
        total += float(np.log10(reach))
        for k in range(order + 1):
            trie[held[at - k : at]][symbol] += 1
    return total


def levels(keys: np.ndarray, n: np.ndarray, two: Counts) -> list[tuple[np.ndarray, ...]]:
    """For each of the sorted (context * 512 + symbol) of order ORDER, by order from the longest: its count, its context's sum, kinds and the sum of what longer contexts exclude.

    `keys` holds all of the corpus for its contexts' last three bytes, `two` all counts of order 2.
    """
    context, symbol = keys >> 9, keys & 511
    tables = {}  # order: (keys, counts, place of each of `keys`)
    for k in range(ORDER, 2, -1):
        key, at = np.unique((context & ((1 << 8 * k) - 1)) * 512 + symbol, return_inverse=True)
        tables[k] = key, np.bincount(at, n, len(key))
    for k in (2, 1, 0):
        key, at = np.unique((two[0] & ((1 << 8 * k) - 1)) * 512 + two[1], return_inverse=True)
        tables[k] = key, np.bincount(at, two[2], len(key))

    def find(all_: np.ndarray, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        if not len(all_):
            return np.zeros(len(of))
        place = np.minimum(np.searchsorted(all_, of), len(all_) - 1)
        return np.where(all_[place] == of, values[place], 0)

    out, excluded = [], np.zeros(len(keys))
    for k in range(ORDER, -1, -1):
        key, count = tables[k]
        here = context & ((1 << 8 * k) - 1)
        some, at = np.unique(key >> 9, return_inverse=True)
        out.append((find(key, count, here * 512 + symbol), find(some, np.bincount(at, count, len(some)), here), find(some, np.bincount(at, count > 0, len(some)), here), excluded))
        if k:  # what this context's symbols count in the next shorter one
            shorter = ((key >> 9) & ((1 << 8 * (k - 1)) - 1)) * 512 + (key & 511)
            excluded = find(some, np.bincount(at, (count > 0) * find(*tables[k - 1], shorter), len(some)), here)
    return out


def gram_logs(keys: np.ndarray, n: np.ndarray, two: Counts) -> np.ndarray:
    """log10 probability of each symbol after its context, as `logs` has it; the sets of longer contexts lie in those of shorter ones."""
    p, reach, done, before = np.zeros(len(keys)), np.ones(len(keys)), np.zeros(len(keys), bool), np.zeros(len(keys))
    for count, total, found, excluded in levels(keys, n, two):
        kinds, rest = found - before, total - excluded
        left = SYMBOLS - before > kinds
        hit = ~done & (count > 0)
        p = np.where(hit, reach * count / np.where(left, np.maximum(rest + kinds, 1), np.maximum(rest, 1)), p)
        done |= hit
        reach = np.where(rest + kinds > 0, np.where(left, reach * kinds / np.maximum(rest + kinds, 1), 0), reach)
        before = found
    p = np.where(done, p, reach / np.maximum(SYMBOLS - before, 1))
    return np.log10(np.maximum(p, 1e-300))


def pieces(data: bytes, limit: int = PIECE_BYTES) -> Iterator[tuple[bytes, bytes, bool]]:
    """(the ORDER bytes before, the piece, whether it is the last) of a text: pieces end after the first blank that `limit` bytes have passed."""
    at = 0
    blank = np.flatnonzero(~SPACED[np.frombuffer(data, np.uint8)]) if len(data) > limit else None
    while True:
        to = len(data)
        if len(data) - at > limit and (k := int(np.searchsorted(blank, at + limit))) < len(blank):
            to = int(blank[k]) + 1
        yield (b"\0" * ORDER + data[max(0, at - ORDER) : at])[-ORDER:], data[at:to], to == len(data)
        at = to
        if at == len(data):
            return


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys into buckets by their whole hash, each in the keys' own order, and where each bucket begins."""
    bucket = (mix(keys.view(np.uint64) ^ np.uint64(0xA5A5)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_CODEC = pa.Codec("zstd", compression_level=3)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def loosened(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True) if any(data[:8]) else b""


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers in few bytes: differences if they ascend, byte by byte, compressed."""
    raw = np.diff(values, prepend=values.dtype.type(0)) if ascending else values
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T).tobytes()
    return squeezed(planes)


def unpacked(data: bytes, kind: type = np.int64, ascending: bool = False) -> np.ndarray:
    planes, width = np.frombuffer(loosened(data), np.uint8), np.dtype(kind).itemsize
    raw = np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).view(kind).ravel()
    return np.cumsum(raw) if ascending else raw


def totals(lists: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, their sums, and the place of each entry among them."""
    keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([np.zeros(0, np.int64), *counts]), len(keys)).astype(np.int64), at


def sums_of(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and how many of each are trained."""
    order = np.argsort(keys, kind="stable")  # of ascending lists one after the other: they are merged
    keys, trained = keys[order], trained[order]
    del order
    lead = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[lead], np.add.reduceat(trained, lead) if len(lead) else np.zeros(0, np.int64)


class Sums:
    """Sums by key that are added up as they come: a list is merged with held ones that are not over twice as long, so that what is held is less than twice the longest list of different keys."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        while self.held and len(self.held[-1][0]) <= 2 * len(keys):
            keys, counts = self.with_last(keys, counts)
        self.held.append((keys, counts))

    def with_last(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other, many = self.held.pop()
        return sums_of(np.concatenate([other, keys]), np.concatenate([many, counts]))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """The different keys, ascending, and their sums; nothing is held after that."""
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while self.held:
            keys, counts = self.with_last(keys, counts)
        return keys, counts


def slices(rows: list[bytes], limit: int) -> Iterator[slice]:
    """Neighbours of about `limit` bytes together, or a single one."""
    first, size = 0, 0
    for k, r in enumerate(rows):
        if k > first and size + len(r) > limit:
            yield slice(first, k)
            first, size = k, 0
        size += len(r)
    yield slice(first, len(rows))


SENT = "bucket long, chunk long, grams binary, n binary, words binary, m binary, docs binary, train binary, closes binary, sizes binary, before binary, texts binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("grams", "n", "words", "m", "docs", "train", "closes", "sizes", "before", "texts"))])
#: kind 0: words and their counts for a chunk; 1: symbols in context for a bucket of the second kind; 2: counts of order 2; 3: totals of words.
COUNTED = "kind int, at long, part long, keys binary, values binary, kinds long, tokens long"
COUNTED_SCHEMA = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("kinds", pa.int64()), ("tokens", pa.int64())])
ANSWER = "chunk long, word boolean, keys binary, values binary"


def sent(docs: DataFrame, buckets: int, limit: int = PIECE_BYTES) -> DataFrame:
    """Of docs (doc_id, train, text): the chunks' different symbols in context and words for each bucket, and in bucket -1 the chunk itself. `docs` numbers the documents, for pieces of one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, chunk, doc = [], 0, TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 40
        for part in (p for batch in batches for p in chunked([batch], limit=limit)):
            for doc_id, train, text in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                for before, piece, last in pieces(text, limit):
                    if held and size + len(piece) > CHUNK * limit:
                        yield from out(held, chunk)
                        held, size, chunk = [], 0, chunk + 1
                    held.append((doc, doc_id, train, before, piece, last))
                    size += len(piece)
                doc += 1
        if held:
            yield from out(held, chunk)

    def out(held: list[tuple], chunk: int) -> list[pa.RecordBatch]:
        doc, ids, train, before, rows, closes = map(list, zip(*held, strict=True))
        trained, found, said = np.asarray(train, np.int64), Sums(), Sums()
        for some in slices(rows, limit):
            context, symbol, text = symbols(rows[some], ORDER, before[some], closes[some])
            found.add(*sums_of(context * 512 + symbol, trained[some][text]))
            of = Words(rows[some], SPACED, LOWER)
            said.add(*sums_of(of.hash.view(np.int64), trained[some][of.doc]))
            del context, symbol, text, of
        (grams, n), (hashes, m) = found.all(), said.all()
        (g, edge), (w, cut) = dealt(grams, buckets), dealt(hashes, buckets)
        table = [
            {"bucket": b, "chunk": chunk, "grams": packed(grams[g[i:j]], True), "n": packed(n[g[i:j]]), "words": packed(hashes[w[k:x]], True), "m": packed(m[w[k:x]])}
            for b, (i, j, k, x) in enumerate(zip(edge, edge[1:], cut, cut[1:], strict=False)) if i < j or k < x
        ]
        named = np.asarray([[d, i is not None, i or 0] for d, i in zip(doc, ids, strict=True)], np.int64)
        table.append({"bucket": -1, "chunk": chunk, "docs": named.tobytes(), "train": trained.astype(np.uint8).tobytes(), "closes": np.asarray(closes, np.uint8).tobytes(), "sizes": packed(np.asarray([len(r) for r in rows], np.int64)), "before": b"".join(before), "texts": squeezed(b"".join(rows))})
        return pa.Table.from_pylist(table, SENT_SCHEMA).to_batches()

    return docs.select("doc_id", "train", F.encode("text", "UTF-8").alias("text")).mapInArrow(each, SENT)


def entries(group: pa.Table, keys: str, many: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [unpacked(k, ascending=True) for k in group.column(keys).to_pylist()], [unpacked(v) for v in group.column(many).to_pylist()]


def summed(group: pa.Table, keys: str, many: str) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of all entries, ascending, and their sums; the entries are opened one at a time."""
    found = Sums()
    for k, v in zip(group.column(keys), group.column(many), strict=True):
        found.add(unpacked(k.as_py(), ascending=True), unpacked(v.as_py()))
    return found.all()


def counted(chunks: DataFrame, buckets: int) -> DataFrame:
    """The buckets' sums, as COUNTED."""

    def each(group: pa.Table) -> pa.Table:
        here = group.column("bucket")[0].as_py()
        hashes, m = entries(group, "words", "m")
        _, c, at = totals(hashes, m)
        cut = np.cumsum([0, *map(len, hashes)])
        out = [{"kind": 0, "at": chunk, "keys": k, "values": packed(c[at[a:b]])} for chunk, k, a, b in zip(group.column("chunk").to_pylist(), group.column("words").to_pylist(), cut, cut[1:], strict=False) if a < b]
        out.append({"kind": 3, "kinds": int((c > 0).sum()), "tokens": int(c.sum())})
        keys, n = summed(group, "grams", "n")
        order, edge = dealt(keys >> 9 & 0xFFFFFF, buckets)
        out += [{"kind": 1, "at": b, "part": here, "keys": packed(keys[order[i:j]], True), "values": packed(n[order[i:j]])} for b, (i, j) in enumerate(zip(edge, edge[1:], strict=False)) if i < j]
        seen = n > 0
        two, many, _ = totals([(keys[seen] >> 9 & 0xFFFF) * 512 + (keys[seen] & 511)], [n[seen]])
        order, edge = dealt(two >> 9, PARTS)
        out += [{"kind": 2, "at": b, "keys": packed(two[order[i:j]], True), "values": packed(many[order[i:j]])} for b, (i, j) in enumerate(zip(edge, edge[1:], strict=False))]
        return pa.Table.from_pylist(out, COUNTED_SCHEMA)

    return chunks.where("bucket >= 0").select("bucket", "chunk", "grams", "n", "words", "m").groupBy("bucket").applyInArrow(each, COUNTED)


def order_two(sums: DataFrame) -> Counts:
    """All counts of order 2, added up in PARTS parts: at most 65,536 contexts of at most 257 symbols, as packed numbers."""

    def each(group: pa.Table) -> pa.Table:
        keys, n = summed(group, "keys", "values")
        return pa.table({"keys": pa.array([packed(keys, True)], pa.binary()), "values": pa.array([packed(n)], pa.binary())})

    found = sums.where("kind = 2").select("at", "keys", "values").groupBy("at").applyInArrow(each, "keys binary, values binary").collect()
    keys = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["keys"], ascending=True) for r in found)])
    n = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["values"]) for r in found)])
    return keys >> 9, keys & 511, n


def answers(chunks: DataFrame, sums: DataFrame) -> DataFrame:
    """The logs of each chunk's symbols in context and the counts of its words, as ANSWER."""
    two = chunks.sparkSession.sparkContext.broadcast(order_two(sums))

    def logs(group: pa.Table) -> pa.Table:
        lists, counts = entries(group, "keys", "values")
        keys, n, at = totals(lists, counts)
        found = gram_logs(keys, n, two.value)[at].astype(np.float32)
        cut = np.cumsum([0, *map(len, lists)])
        return pa.table({"bucket": group.column("part"), "keys": group.column("keys"), "values": pa.array([packed(found[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    def give(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.int64), *(unpacked(k, ascending=True) for k in known.column("keys").to_pylist())])
        values = np.concatenate([np.zeros(0, np.float32), *(unpacked(v, np.float32) for v in known.column("values").to_pylist())])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = [packed(values[np.searchsorted(keys, unpacked(k, ascending=True))]) for k in asked.column("grams").to_pylist()]
        return pa.table({"chunk": asked.column("chunk"), "word": pa.array([False] * len(out)), "keys": asked.column("grams"), "values": pa.array(out, pa.binary())})

    known = sums.where("kind = 1").select("at", "part", "keys", "values").groupBy("at").applyInArrow(logs, "bucket long, keys binary, values binary")
    asked = chunks.where("bucket >= 0").select("bucket", "chunk", "grams")
    grams = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(give, ANSWER)
    return grams.union(sums.where("kind = 0").select(F.col("at").alias("chunk"), F.lit(True).alias("word"), "keys", "values"))


SCORED = "doc long, doc_id long, train boolean, n_tokens long, n_known long, logs double, score double"


def merged(chunks: DataFrame, answered: DataFrame, limit: int = PIECE_BYTES) -> DataFrame:
    """SCORED for each piece of each chunk: the sums over its symbols and words."""

    def each(asked: pa.Table, got: pa.Table) -> pa.Table:
        row = asked.to_pylist()[0]
        body, ends, closes = loosened(row["texts"]), np.cumsum(unpacked(row["sizes"])).tolist(), np.frombuffer(row["closes"], np.uint8).astype(bool)
        rows = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        before = [row["before"][k : k + ORDER] for k in range(0, len(row["before"]), ORDER)]

        def answer(word: bool, kind: type) -> tuple[np.ndarray, np.ndarray]:
            mine = [(k, v) for w, k, v in zip(*(got.column(c).to_pylist() for c in ("word", "keys", "values")), strict=True) if w == word]
            keys = np.concatenate([np.zeros(0, np.int64), *(unpacked(k, ascending=True) for k, _ in mine)])
            values = np.concatenate([np.zeros(0, kind), *(unpacked(v, kind) for _, v in mine)])
            order = np.argsort(keys)
            return keys[order], values[order]

        (grams, logs_), (hashes, counts) = answer(False, np.float32), answer(True, np.int64)
        score, tokens, known, base = [], [], [], []
        for some in slices(rows, limit):
            n = len(rows[some])
            context, symbol, text = symbols(rows[some], ORDER, before[some], closes[some].tolist())
            key, at = np.unique(context * 512 + symbol, return_inverse=True)
            score.append(np.bincount(text, logs_[np.searchsorted(grams, key)][at].astype(float), n).astype(float))
            of = Words(rows[some], SPACED, LOWER)
            key, at = np.unique(of.hash.view(np.int64), return_inverse=True)
            c = counts[np.searchsorted(hashes, key)][at]
            tokens.append(of.count)
            known.append(np.bincount(of.doc, c > 0, n).astype(np.int64))
            base.append(np.bincount(of.doc, np.log10(c + 1.0), n).astype(float))
        docs = np.frombuffer(row["docs"], np.int64).reshape(-1, 3)
        numbers = {"doc": docs[:, 0], "n_tokens": np.concatenate(tokens) + closes, "n_known": np.concatenate(known), "logs": np.concatenate(base), "score": np.concatenate(score)}
        out = {k: pa.array(v) for k, v in numbers.items()} | {"doc_id": pa.array(docs[:, 2], mask=docs[:, 1] == 0), "train": pa.array(np.frombuffer(row["train"], np.uint8).astype(bool))}
        return pa.table({c.split()[0]: out[c.split()[0]] for c in SCORED.split(", ")})

    asked = chunks.where("bucket < 0").select("chunk", "docs", "train", "closes", "sizes", "before", "texts")
    return asked.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(each, SCORED)


def score(docs: DataFrame, limit: int = PIECE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    A null text is empty and has its end alone; a null id's text is the empty text. Without training texts every symbol is
    equally likely and no word is known. Rows repeated with id and text count as often as they are there and get equal
    values; texts longer than `limit` bytes are scored piece by piece; no rows, no rows. Columns other than doc_id and text
    are not read.
    """
    rows = texts(docs).withColumn("train", remainder() != HELD_OUT)
    ends, size = rows.agg(F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(4, partitions(docs.sparkSession), size >> BUCKET_BITS)
    chunks = written(sent(rows, buckets, limit), "chunks")
    sums = written(counted(chunks, buckets), "counts")
    kinds, tokens = sums.where("kind = 3").agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    n, v = tokens + ends, kinds + (ends > 0)
    got = merged(chunks, answers(chunks, sums), limit)
    whole = got.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score")])
    base = F.col("logs") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return whole.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
