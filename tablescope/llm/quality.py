"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader (proximal) updates.

Features of a text are hashed into 2 ** BITS places: its words and pairs of neighbouring words as they are, the same with
each word replaced by its shape (letters' case, digits, length; repeated or not), and its marks. A place's value is its
share of the text's features, so long texts count no more than short ones. Labels, ids, sources and languages are no
features. The model is fitted on the driver on at most MAX_TRAIN labelled rows, which bounds its memory at any size of
the corpus; scoring is a sparse dot product over whole texts and has no limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, chunked, encoded, mix, packed_rows, run_hashes, texts, unpacked_rows

BITS = 18
#: Labelled rows used at most: those whose hashed ids are the smallest.
MAX_TRAIN = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.0002, 0.0001
HELD_OUT = 1
#: 0 blank, 1 lower-case letter or beyond ASCII, 2 upper case, 3 digit, 4 any other mark.
KIND = np.full(256, 4, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[97:123] = 1
KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3


def features(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of the features of each text, a text's places in no order and possibly more than once."""
    raw = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    last = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) + 1) - 1
    kind = KIND[raw]
    sort = np.where(kind == 2, 1, kind)  # words have letters of both cases
    sort[last] = 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], sort))))
    start = edge[sort[edge] > 0]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ends = np.append(edge[1:], len(sort))[sort[edge] > 0]
    doc = np.searchsorted(last, start)
    word = run_hashes(LOWER[raw], start, ends)
    upper = np.add.reduceat((kind == 2).astype(np.int64), np.column_stack([start, ends]).ravel())[::2]  # ends never reach past the last blank
    size = ends - start
    again = np.zeros(len(start), np.int64)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    case = np.where(upper == 0, 0, np.where((upper == 1) & (kind[start] == 2), 1, np.where(2 * upper >= size, 2, 3)))
    shape = mix(((sort[start].astype(np.int64) * 4 + case) * 8 + np.minimum(size // 3, 7) * 1).astype(np.uint64) * np.uint64(2) + again.astype(np.uint64) + np.uint64(1 << 32))
    shape = np.where(sort[start] >= 3, mix(word + np.uint64(7)), shape)  # digits and marks stand for themselves
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    found = [(doc, word), (doc[pair], mix(word[pair] * np.uint64(3) + word[pair + 1])), (doc, shape), (doc[pair], mix(shape[pair] * np.uint64(5) + shape[pair + 1]))]
    docs = np.concatenate([d for d, _ in found])
    place = (np.concatenate([h for _, h in found]) >> np.uint64(64 - BITS)).astype(np.int64)
    return docs, place, 1.0 / np.bincount(docs, minlength=len(rows))[docs]


def sparse(rows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text, each place once; a last place is the constant."""
    out = []
    for row in rows:
        _, place, value = features([row])
        places, at = np.unique(place, return_inverse=True)
        out.append((np.append(places, 1 << BITS).astype(np.int32), np.append(np.sqrt(np.bincount(at, value, len(places))), 1.0).astype(np.float32)))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the places; rows are taken in an order that follows from their number alone. Rare labels weigh more."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    ones = sum(labels)
    share = {1: 0.5 * len(labels) / max(1, ones), 0: 0.5 * len(labels) / max(1, len(labels) - ones)}

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, value = rows[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - labels[k]) * share[labels[k]] * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def remainder(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """The model's weights, learned from labelled rows that are not held out; without any, all are 0 and every score is 0.5.

    Contradicting labels of one document count one by one. The labels are cut down to `max_train` ids before they meet
    the texts, so that the texts of no other documents are moved.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = known.where(remainder() != HELD_OUT).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
    # at most max_train rows of two numbers: small by a stated bound
    found = texts(docs).join(F.broadcast(chosen), "doc_id")
    # of rows that share an id the text of the least hash: no more rows than were chosen
    first = found.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = first.select("doc_id", "quality", F.encode("t.text", "UTF-8").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            found = sparse(encoded(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks(), part.column("quality").combine_chunks(), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                names=["doc_id", "quality", "places", "shares"],
            )

    got = rows.mapInArrow(each, "doc_id long, quality int, places binary, shares binary").collect()  # max_train rows at most
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["places"]))
    return fit([(np.frombuffer(r["places"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in got], [r["quality"] for r in got])


def scorer(weights: np.ndarray):  # noqa: ANN201
    def scores(rows: list[bytes]) -> np.ndarray:
        docs, place, value = features(rows)
        width = np.int64(1 << BITS)
        keys, at = np.unique(docs * width + place, return_inverse=True)
        shares = np.sqrt(np.bincount(at, value, len(keys)))
        margin = np.bincount(keys // width, weights[keys % width] * shares, len(rows)) + weights[-1]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    return scores


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc (a row of docs as a struct, so that its columns may have any names), score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    A null text is scored as an empty one, which has the constant alone. Repeated rows get equal scores; a score of 0.5 is
    predicted 1; no rows, no rows; without labels every score is 0.5.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train))  # 2 ** BITS numbers

    at = [c.lower() for c in docs.columns].index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(weights.value)
        texts = lambda rows: rows.field(at).cast(pa.string()).cast(pa.binary())  # noqa: E731 - the text is sent once, in its row
        for part in chunked(pa.RecordBatch.from_arrays([b.column(0), texts(b.column(0))], names=["doc", "text"]) for b in batches):
            got = scores(encoded(part.column("text")))
            part = part.drop_columns("text").append_column("score", pa.array(got)).append_column("predicted", pa.array((got >= 0.5).astype(np.int32)))
            yield from part.combine_chunks().to_batches()

    rows = packed_rows(docs.withColumn("text", F.col("text").cast("string")))
    schema = T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(each, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    A null id counts as the empty text where it is dealt out; repeated rows get equal results; no rows, no rows.
    """
    rows = score(texts(docs), labels).select("doc.doc_id", "score", "predicted")
    return rows.select("doc_id", (remainder() == HELD_OUT).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject (a score of 0.5 is kept), with docs' columns.

    Repeated rows stay or go together; a null text is judged as an empty one; no rows, no rows.
    """
    return unpacked_rows(score(docs, labels).where("predicted = 1"), docs.columns)
