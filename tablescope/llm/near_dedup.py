"""Near-duplicate classes by BagMinHash signatures of weighted five-word shingles, bands, and verified multiset overlap.

A text is the multiset of its shingles, five words each. Each shingle and each interval of the discretised weights (0, 1],
(1, 2], (2, 4], (4, 8], ... has a Poisson process of its own, whose rate is the interval's length: points come in ascending
time, each for a register at random, and each at a weight in its interval. The weight's binary digits are the halves of the
interval that the point falls into, level by level: halving a process only ever deals its points out, so all levels of the
hierarchy are in one draw, and no level is made that no weight asks for. A text takes the points of its shingles up to their
weights, and a register keeps the earliest. Two texts agree in a register with the probability of their weighted
Jaccard similarity. A process stops once it is later than all registers, so that most are left after a point or two.

Texts that agree in all registers of a band are candidates. Components of candidates bound where a link can be; inside
them pairs that share a band are verified by the exact multiset overlap until they are known to be connected. Components
of more than GROUP texts are split: links are verified within the parts first, then, for every band, between up to MEMBERS
texts of each class found so far. These rounds only save work: in the last one all texts of different classes that share a
bucket meet, in pairs of blocks, each pair of texts in the first band that it shares. Members of a bucket's largest class do
not meet each other, so that a bucket of near copies with a few outsiders stays in proportion to its size. Classes are the
components of verified links.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, Words, chunked, encoded, identity, mix, packed_rows, unpacked_rows, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
GROUP = 256
MEMBERS = 8
SALTS = 16
#: Texts of a block in the last round.
BLOCK = 256


def shingles(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of some texts, sorted. A text of fewer than five words is one shingle; without words, none."""
    words = Words(rows, SPACED, LOWER)
    n, h = len(words.hash), words.hash
    long_ = words.count >= SHINGLE
    total = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total = mix(total * np.uint64(31) + h[k : k + len(total)])
    ok = words.doc[: len(total)] == words.doc[SHINGLE - 1 :][: len(total)] if len(total) else np.zeros(0, bool)
    doc, found = [words.doc[: len(total)][ok]], [total[ok]]
    short = np.flatnonzero(~long_ & (words.count > 0))
    first = np.cumsum(words.count) - words.count
    for d in short:
        value = np.full(1, 17, np.uint64)
        for k in range(first[d], first[d] + words.count[d]):
            value = mix(value * np.uint64(31) + h[k : k + 1])
        doc.append(np.asarray([d]))
        found.append(value)
    doc, found = np.concatenate(doc), np.concatenate(found)
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    lead = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])))) if len(doc) else np.zeros(0, np.int64)
    return doc[lead], found[lead], np.diff(np.append(lead, len(doc)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(texts: int, doc: np.ndarray, item: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Registers (texts, REGISTERS): the time of the earliest point of each, infinite where there is no item."""
    parts = [(doc, item, np.zeros(len(doc)), np.ones(len(doc)), weight)]
    low = 1
    while (more := np.flatnonzero(weight > low)).size:  # the dyadic intervals (low, 2 * low] that a weight reaches into
        parts.append((doc[more], mix(item[more] + np.uint64(low * 0x9E3779B97F4A7C15 % (1 << 64))), np.full(len(more), float(low)), np.full(len(more), float(low)), weight[more]))
        low *= 2
    doc, seed, base, rate, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    registers = np.full(texts * REGISTERS, np.inf)
    time, k = np.zeros(len(doc)), 0
    partial = base + rate > weight
    while len(doc):
        k += 1
        draw = mix(seed + np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)))
        time = time - np.log(_uniform(draw)) / rate
        draw = mix(draw + np.uint64(1))
        at = doc * REGISTERS + (draw % np.uint64(REGISTERS)).astype(np.int64)
        # the point's weight: base + 1 to base + rate, in whole steps
        inside = ~partial | (base + np.ceil(_uniform(mix(draw + np.uint64(2))) * rate) <= weight)
        np.minimum.at(registers, at[inside], time[inside])
        go = time < registers.reshape(texts, REGISTERS).max(1)[doc]
        doc, seed, base, rate, weight, time, partial = (x[go] for x in (doc, seed, base, rate, weight, time, partial))
    return registers.reshape(texts, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    bits = registers.view(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(registers), 1), np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(31) + bits[:, :, k])
    return key.view(np.int64)


def node_names(texts: int, doc: np.ndarray, item: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A 64-bit name for each text's multiset."""
    name = np.zeros(texts, np.uint64)
    np.add.at(name, doc, mix(mix(item) + times.astype(np.uint64)))
    return mix(name).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """Of docs (doc, row, doc_id, text): doc, row, doc_id, node and the band keys, null for texts without words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            rows = encoded(part.column("text"))
            doc, item, times = shingles(rows)
            keys = band_keys(signatures(len(rows), doc, item, times))
            node = node_names(len(rows), doc, item, times)
            has = np.bincount(doc, minlength=len(rows)) > 0
            bands = pa.array([k.tolist() if x else None for k, x in zip(keys, has, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("doc", "row", "doc_id")), pa.array(node), bands], names=["doc", "row", "doc_id", "node", "bands"])

    return docs.mapInArrow(each, "doc long, row long, doc_id long, node long, bands array<long>")


def components(edges: DataFrame, tag: str) -> DataFrame:
    """node and label, the smallest node of its component, of each node of the edges a - b. Labels go to neighbours, then to the label's label, until none changes."""
    both = edges.select("a", "b").where("a <> b").distinct()
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{tag}-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("of"), F.col("label").alias("far"))
        moved = written(step.join(jump, step.new == jump.of, "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")), f"{tag}-labels")
        changed = moved.where("label <> new").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def overlap(a: tuple, b: tuple) -> float:
    """Multiset Jaccard similarity of two (sorted items, times, sum of times)."""
    if min(a[2], b[2]) < THRESHOLD * max(a[2], b[2]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    shared = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (a[2] + b[2] - shared)


def linked(nodes: list[int], keys: np.ndarray, bags: list[tuple], same: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Verified links that connect all that share a band and overlap, given what is connected already (equal `same`); and the class of each."""
    up = list(range(len(nodes)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    first: dict[int, int] = {}
    for k, s in enumerate(same):
        up[root(k)] = root(first.setdefault(s, k))
    links, tried = [], set()
    for band in range(keys.shape[1]):
        buckets: dict[int, list[int]] = defaultdict(list)
        for k, key in enumerate(keys[:, band].tolist()):
            buckets[key].append(k)
        for some in buckets.values():
            for i, x in enumerate(some):
                for y in some[:i]:
                    if root(x) != root(y) and (y, x) not in tried:
                        tried.add((y, x))
                        if overlap(bags[x], bags[y]) >= THRESHOLD:
                            up[root(x)] = root(y)
                            links.append((nodes[x], nodes[y]))
    return links, [root(k) for k in range(len(nodes))]


BAG = "items binary, times binary"


def _bags(table: pa.Table) -> list[tuple]:
    out = []
    for items, times in zip(table.column("items").to_pylist(), table.column("times").to_pylist(), strict=True):
        t = np.frombuffer(times, np.int64)
        out.append((np.frombuffer(items, np.uint64), t, int(t.sum())))
    return out


def bagged(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds items and times, the multiset of `text`, to the named columns."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            rows = encoded(part.column("text"))
            doc, item, times = shingles(rows)
            edge = np.searchsorted(doc, np.arange(len(rows) + 1))
            columns = [part.column(c).combine_chunks() for c in names]
            items = pa.array([item[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())
            many = pa.array([times[a:b].astype(np.int64).tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, items, many], names=[*names, "items", "times"])

    return bag


def meeting(at: DataFrame) -> DataFrame:
    """bucket, i, j, node, class, band, side: the texts of `at` (node, class, band, bucket) in the pairs of blocks where texts of different classes of a bucket meet.

    A bucket's largest class has its members in blocks of their own, which never meet each other. All other texts come in
    blocks that meet each block of the bucket once. So a bucket of n texts with m outside the largest class makes
    n + m * n / BLOCK rows at most, and a bucket of one class makes none.
    """
    at = at.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    per = written(at.groupBy("bucket", "class").agg(F.count("*").alias("n")), "bucket-classes")
    mixed = per.groupBy("bucket").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n")).where("n > inside")
    mixed = written(mixed.select("bucket", "main", F.ceil(F.col("inside") / BLOCK).cast("long").alias("mains"), F.ceil((F.col("n") - F.col("inside")) / BLOCK).cast("long").alias("others")), "mixed-buckets")
    every_salt = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    inside = F.col("class") == F.col("main")
    placed = at.join(every_salt, ["bucket", "salt"]).withColumn("side", inside.cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.when(inside, F.col("mains")).otherwise(F.col("others"))) + F.when(inside, F.col("others")).otherwise(F.lit(0)))
    # blocks 0 to others - 1 hold the texts outside the largest class, the next ones those inside
    least = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    placed = placed.select("bucket", "node", "class", "band", "block", "side", F.explode(F.sequence(F.lit(0).cast("long"), least - 1)).alias("other"))
    return placed.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "class", "band", "block")


def across(group: pa.Table) -> pa.Table:
    """Verified links between texts of different classes of two blocks, or of one block with itself, in the first band that they share."""
    group = group.sort_by("node")
    nodes, class_ = np.asarray(group.column("node")), np.asarray(group.column("class"))
    keys = np.asarray(group.column("bands").to_pylist(), np.int64)
    blocks, band = np.asarray(group.column("block")), group.column("band")[0].as_py()
    one = group.column("i")[0] == group.column("j")[0]
    bags = _bags(group)
    total = np.asarray([t for *_, t in bags])
    left = np.arange(len(nodes)) if one else np.flatnonzero(blocks == group.column("i")[0].as_py())
    right = left if one else np.flatnonzero(blocks != group.column("i")[0].as_py())
    # the right block's shingles in one order, each with its text and its times
    items = np.concatenate([np.zeros(0, np.uint64), *(bags[k][0] for k in right)])
    of = np.repeat(np.arange(len(right)), [len(bags[k][0]) for k in right])
    times = np.concatenate([np.zeros(0, np.int64), *(bags[k][1] for k in right)])
    order = np.argsort(items, kind="stable")
    items, of, times = items[order], of[order], times[order]
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            up[c] = up.get(up[c], up[c])
            c = up[c]
        return c

    links = []
    for x in left.tolist():
        other = (class_[right] != class_[x]) & (np.minimum(total[right], total[x]) >= THRESHOLD * np.maximum(total[right], total[x])) & ~(keys[right, :band] == keys[x, :band]).any(1)
        if one:
            other &= right > x
        if not other.any():
            continue
        mine, many, _ = bags[x]
        lo, hi = np.searchsorted(items, mine), np.searchsorted(items, mine, side="right")
        size = hi - lo
        at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        same = np.bincount(of[at], np.minimum(times[at], np.repeat(many, size)), len(right))
        for k in np.flatnonzero(other & (same / (total[right] + total[x] - same) >= THRESHOLD)).tolist():
            a, b = root(int(class_[x])), root(int(class_[right[k]]))
            if a != b:
                up[a] = b
                links.append((int(nodes[x]), int(nodes[right[k]])))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def classes(docs: DataFrame) -> DataFrame:
    """row, doc_id, class_id (the smallest doc_id of the class) and class_size of each row of docs (doc, row, doc_id, text).

    Texts of one multiset of shingles are one node from the start; texts without words are one class.
    """
    every = written(signed(docs), "signatures")
    nodes = every.groupBy("node").agg(F.min(F.struct("doc", "row")).alias("of"), F.first("bands").alias("bands"))
    spread = nodes.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a node's buckets are one through it: it goes to its least hub, and hubs are linked among each other, of which there are few in a group of copies
    met = written(spread.join(hubs, "bucket").groupBy("node").agg(F.min("hub").alias("low"), F.collect_set("hub").alias("hubs")), "hubs")
    among = components(met.select(F.col("low").alias("a"), F.explode("hubs").alias("b")), "candidates")
    groups = written(met.select("node", "low").join(among.withColumnRenamed("node", "low"), "low", "left").select("node", F.coalesce("label", "low").alias("label")), "candidates")
    sizes = written(groups.groupBy("label").agg(F.count("*").alias("size")), "group-sizes")
    placed = groups.join(sizes, "label").select("node", "label", "size", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP).cast("long")).alias("part"))
    chosen = placed.join(nodes, "node").select("of.doc", "of.row", "node", "label", "size", "part", "bands")
    names = ["node", "label", "size", "part", "bands"]
    # the texts are met once: the shingles of all candidates are written and serve every round
    bags = written(docs.select("doc", "row", "text").join(chosen, ["doc", "row"]).select(*names, "text").mapInArrow(bagged(names), f"node long, label long, size long, part long, bands array<long>, {BAG}"), "shingles")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("class", pa.int64())])

    def within(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        names = group.column("node").to_pylist()
        firsts = [k for k, n in enumerate(names) if not k or names[k - 1] != n]  # equal rows of one node
        group = group.take(firsts)
        names, keys = [names[k] for k in firsts], np.asarray(group.column("bands").to_pylist(), np.int64)
        links, roots = linked(names, keys, _bags(group), names)
        out = [{"a": a, "b": b, "class": None} for a, b in links]
        if group.column("size")[0].as_py() > GROUP:  # some of each class go on
            seen: dict[int, int] = defaultdict(int)
            for k, r in enumerate(roots):
                seen[r] += 1
                if seen[r] <= MEMBERS:
                    out.append({"a": names[k], "b": None, "class": names[r]})
        return pa.Table.from_pylist(out, schema)

    first = written(bags.groupBy("label", "part").applyInArrow(within, "a long, b long, class long"), "links")
    large = bags.where(F.col("size") > GROUP).drop("label", "size", "part").dropDuplicates(["node"])
    going = first.where("b IS NULL").select(F.col("a").alias("node"), "class").join(large, "node")
    at = going.select("node", "class", F.posexplode("bands").alias("band", "key")).select("node", "class", F.xxhash64("band", "key").alias("bucket"))
    mixed = at.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n")).where("least <> most").select("bucket", "n")
    meet = at.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / GROUP).cast("long")))
    meet = meet.select("node", "bucket", "part").join(going, "node")

    def between(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        names = group.column("node").to_pylist()
        links, _ = linked(names, np.zeros((len(names), 1), np.int64), _bags(group), group.column("class").to_pylist())
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    second = meet.select("bucket", "part", "node", "class", "items", "times").groupBy("bucket", "part").applyInArrow(between, "a long, b long")
    links = written(first.where("b IS NOT NULL").select("a", "b").union(second), "links")
    found = components(links, "classes")

    # the last round: all texts of buckets that are still of several classes
    rest = large.select("node", "bands").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("class"), F.posexplode("bands").alias("band", "key"))
    pairs = written(meeting(rest.select("node", "class", "band", F.xxhash64("band", "key").alias("bucket"))), "meetings")
    if pairs.limit(1).count():
        third = pairs.join(large, "node").groupBy("bucket", "i", "j").applyInArrow(across, "a long, b long")
        found = components(links.union(third), "classes")
    named = every.select("row", "doc_id", "node").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = written(named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept"), F.count("*").alias("class_size")).where("class_size > 1"), "classes")
    joined = named.join(whole, "label", "left")
    return joined.select("row", "doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(F.col("kept.row") == F.col("row"), F.lit(True)).alias("kept"))


def with_rows(docs: DataFrame) -> DataFrame:
    doc, row = identity()
    return docs.select(doc, row, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size of every row of docs; class_id is the smallest doc_id of the class.

    A null text is empty; rows without words are one class; repeated rows are in one class; a class without any doc_id has
    none; no rows, no rows. Columns other than doc_id and text are not read.
    """
    return classes(with_rows(docs)).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id (null last), with docs' columns, of any names; of rows equal in id and text the one of the least hash of all columns stays; no rows, no rows."""
    kept = classes(with_rows(docs)).where("kept").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "row").distinct()
    doc, row = identity()
    rows = packed_rows(docs, doc.alias("id"), row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")).join(kept, ["id", "row"], "left_semi")
    return unpacked_rows(rows.groupBy("id", "row").agg(F.min_by("doc", "all").alias("doc")), docs.columns)


#: All pairs that share a shingle, their exact overlap, and the links' transitive closure.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
c AS (SELECT rid, g, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT rid, sum(n) AS z FROM c GROUP BY 1),
p AS (SELECT a.rid AS x, b.rid AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN z zx ON zx.rid = x JOIN z zy ON zy.rid = y WHERE m / (zx.z + zy.z - m)::DOUBLE >= 0.8),
both_ AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT rid, rid FROM d UNION SELECT reach.x, both_.y FROM reach JOIN both_ ON reach.y = both_.x),
labelled AS (SELECT d.rid, any_value(doc_id) AS doc_id, CASE WHEN len(any_value(w)) = 0 THEN 0 ELSE min(y) END AS label FROM d JOIN reach ON d.rid = reach.x GROUP BY d.rid)
SELECT doc_id, min(doc_id) OVER (PARTITION BY label) AS class_id, count(*) OVER (PARTITION BY label) AS class_size FROM labelled
"""
