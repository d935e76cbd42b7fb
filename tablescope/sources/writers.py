"""Sinks: JSON lines, CSV, deterministic manifests, per-split folders, and small reports rendered on the driver."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that a report rendered on the driver may have.
REPORT_ROWS = 10_000


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.option("escape", '"').csv(path, header=True)


def manifest(rows: DataFrame, path: str, order: str = "path") -> None:
    """Tab-separated and sorted: the parts one after another are in order."""
    rows.orderBy(order).write.csv(path, sep="\t")


def by_split(rows: DataFrame, path: str, split: str = "split") -> None:
    rows.write.partitionBy(split).parquet(path)


def summary_json(rows: DataFrame) -> str:
    """A single row as a JSON document."""
    found = rows.limit(2).toJSON().collect()
    if len(found) != 1:
        raise ValueError("a summary has one row")
    return json.dumps(json.loads(found[0]), indent=2, ensure_ascii=False)


def _collected(rows: DataFrame) -> list:
    found = rows.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError(f"a report has {REPORT_ROWS} rows at most")
    return found


def _shown(value) -> str:  # noqa: ANN001
    return "-" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown(rows: DataFrame) -> str:
    names = rows.columns
    lines = [f"| {' | '.join(names)} |", f"|{'|'.join(' --- ' for _ in names)}|"]
    lines += [f"| {' | '.join(_shown(v).replace('|', chr(92) + '|') for v in row)} |" for row in _collected(rows)]
    return "\n".join(lines) + "\n"


def html_table(rows: DataFrame) -> str:
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape(_shown(v))}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', row)}</tr>" for row in _collected(rows))
    return f"<table><thead><tr>{cells('th', rows.columns)}</tr></thead><tbody>{body}</tbody></table>"


def html_report(title: str, tables: dict[str, DataFrame]) -> str:
    """A document with a heading and a table for each section; everything is escaped."""
    sections = "".join(f"<h2>{html.escape(name)}</h2>{html_table(rows)}" for name, rows in tables.items())
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{sections}</body></html>"


def by_shard(rows: DataFrame, path: str, shard: str, key: str) -> DataFrame:
    """Writes a folder for each shard, and returns a row for each: rows, first and last key."""
    rows.write.partitionBy(shard).parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy(shard).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))


def system_of(spark: SparkSession, path: str) -> tuple:
    """The file system that a path names, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file in one step; false if there is one at the target."""
    system, where = system_of(spark, source)
    to = system_of(spark, target)[1]
    return not system.exists(to) and bool(system.rename(where, to))


def by_file(rows: DataFrame, path: str = "path", text: str = "text") -> None:
    """A small file for each row (path, text), written by the tasks that have the rows; a task that runs again writes the same ones again. The paths' file system is one that pyarrow knows, as local and object stores are."""

    def each(part: Iterator) -> None:
        from pyarrow import fs

        for row in part:
            system, name = fs.FileSystem.from_uri(row[0])
            system.create_dir(name.rpartition("/")[0])
            with system.open_output_stream(name) as out:
                out.write(row[1].encode())

    rows.select(path, text).foreachPartition(each)


def json_documents(rows: DataFrame, path: str, brackets: str, member: str, order: str, document: str = "document") -> None:
    """A folder for each document with one file: its members, texts of JSON, a line each in their order, between brackets.

    The brackets stand in the first and the last member's lines: as rows of their own, in a union, they could come to other
    tasks than the members, and so into other files.
    """
    w = W.partitionBy(document).orderBy(order)
    placed = rows.select(document, F.col(member).alias("member"), F.row_number().over(w).alias("place"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    line = F.concat(F.when(F.col("place") == 1, F.lit(f"{brackets[0]}\n")).otherwise(F.lit(",")), "member", F.when(F.col("last"), F.lit(f"\n{brackets[1]}")).otherwise(F.lit("")))
    lines = placed.select(document, "place", line.alias("line")).repartition(document).sortWithinPartitions(document, "place")
    lines.select(document, "line").write.partitionBy(document).text(path)


def mark_ready(spark: SparkSession, folder: str, name: str = "READY") -> None:
    """A marker beside the data, after the folder's own _SUCCESS: raises if that is not there."""
    if not is_ready(spark, folder, "_SUCCESS"):
        raise ValueError(f"{folder} is not complete")
    system, where = system_of(spark, f"{folder.rstrip('/')}/{name}")
    system.create(where, True).close()


def is_ready(spark: SparkSession, folder: str, name: str = "READY") -> bool:
    system, where = system_of(spark, f"{folder.rstrip('/')}/{name}")
    return bool(system.exists(where))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of a given name, through the file system that the path names."""
    system, where = system_of(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
