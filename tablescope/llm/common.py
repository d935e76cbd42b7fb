"""What the operators share: reading tables, writing intermediate tables, words and hashes of texts in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that a Python worker handles at a time: numpy's temporary arrays stay under about 50 times this.
CHUNK_BYTES = 1 << 19
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


#: CTEs for DuckDB: crcs (s, crc), the unsigned crc32 of the UTF-8 bytes of each string of the query {strings}, byte by byte over a table that is made bit by bit.
CRC32_SQL = """
crc_bits(b, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT b, v FROM crc_bits WHERE k = 8),
crc_strings AS ({strings}),
crc_steps(s, h, k, c) AS (
  SELECT s, hex(encode(s)), 0, 4294967295::BIGINT FROM crc_strings
  UNION ALL SELECT s, h, k + 1, xor(v, c // 256) FROM crc_steps JOIN crc_table ON b = xor(c % 256, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) WHERE 2 * k < length(h)),
crcs AS (SELECT s, xor(c, 4294967295) AS crc FROM crc_steps WHERE 2 * k = length(h))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column of any name can clash; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def scratch(spark: SparkSession) -> str:
    """The folder shared by driver and executors for intermediate tables: spark.checkpoint.dir. Where it is unset it is set to a local folder if driver and executors are one process, as in tests, and is an error on a cluster."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tablescope-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """The rows of df written to the shared folder and read back, in so many files if given: lineage ends here, and a lost executor costs nothing that was done before."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.repartition(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """The rows of the batches in order, cut so that a part holds about `limit` bytes of `column`, or a single longer row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield pa.Table.from_batches([batch.slice(at, to - at)])
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run data[start:end]; the runs are disjoint, not empty and in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    power = _powers(int(size.max()) + 1)
    values = _BYTE[data[inside + np.repeat(start, size)]] * power[inside]
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64) * _MIX)


class Words:
    """The words of some texts: `doc`, the text of each word, its 64-bit `hash`, and its place `start`, `end` in `data`, all the texts' bytes with a separator after each."""

    def __init__(self, rows: list[bytes], is_word: np.ndarray, fold: np.ndarray | None = None) -> None:
        data = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
        self.data = data if fold is None else fold[data]
        inside = is_word[self.data]
        size = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
        last = np.cumsum(size) - 1
        if len(rows):
            inside[last] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(last, self.start)
        self.hash = run_hashes(self.data, self.start, self.end)
        self.count = np.bincount(self.doc, minlength=len(rows))


def byte_set(out: bytes) -> np.ndarray:
    """True for each byte that is not in `out`."""
    found = np.ones(256, bool)
    found[np.frombuffer(out, np.uint8)] = False
    return found


#: Words are runs of anything but the ASCII white space 20 and 09 to 0D.
BLANK = bytes([0x20, *range(0x09, 0x0E)])
SPACED = byte_set(BLANK)
#: A-Z to a-z, anything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def encoded(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def python_path(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver's program was started."""
    ship(spark)


def packed_rows(docs: DataFrame, *more: F.Column) -> DataFrame:
    """`doc`, all columns of a row as a struct, whatever their names, beside columns of our own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *more)


def unpacked_rows(rows: DataFrame, names: list[str], **changed: F.Column) -> DataFrame:
    """The columns of `doc` again, some of them changed."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("doc").getField(c).alias(c) for c in names])


def identity(doc_id: str = "doc_id", text: str = "text") -> tuple[F.Column, F.Column]:
    """`doc` and `row`, the id (the least number for a null one) and a hash of id and text: rows that share both and differ in their texts would need one id and one hash."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("row")
