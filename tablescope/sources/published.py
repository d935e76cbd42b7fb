"""Published tables: rows become visible as whole commits, or not at all.

A commit writes its rows to a folder of its own, whose name readers never guess, and then puts a small marker beside it that names
the folder and its number of rows. The marker is the commit: it is written under another name and renamed, so that it is there
whole or not at all. A job that fails leaves no marker, and its folder is deleted. A commit has an id; a second one of that id
changes nothing, so that a streaming batch that is run again after a crash counts once. All of it goes through the file system
that the path names; executors write with Spark's own writers.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .writers import put_text, rename, system_of

MARKER = "READY"


class Commit(NamedTuple):
    id: str
    folder: str
    rows: int


def _marker(target: str, name: str) -> str:
    return f"{target.rstrip('/')}/{MARKER}-{name}"


def commits(spark: SparkSession, target: str) -> list[Commit]:
    """The commits of a table, by id: a small file each."""
    system, where = system_of(spark, target)
    if not system.exists(where):
        return []
    found = [str(x.getPath()) for x in system.listStatus(where) if x.getPath().getName().startswith(f"{MARKER}-")]
    return sorted(Commit(**json.loads(_text(spark, path))) for path in found)


def _text(spark: SparkSession, path: str) -> str:
    system, where = system_of(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(rows: DataFrame, target: str, name: str = "all", form: str = "parquet") -> Commit:
    """Writes rows as the commit `name` of a table; if that commit is there already, nothing is done.

    A failed job raises, its folder is deleted, and no reader sees a row. The number of rows is observed while they are written.
    No rows make an empty commit.
    """
    spark = rows.sparkSession
    if done := [c for c in commits(spark, target) if c.id == name]:
        return done[0]
    folder = f"{target.rstrip('/')}/_{name}-{uuid.uuid4().hex}"
    counted = Observation()
    try:
        rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.format(form).save(folder)
        commit = Commit(name, folder, counted.get["rows"])
        put_text(spark, f"{folder}.marker", json.dumps(commit._asdict()))
    except Exception:
        system, where = system_of(spark, folder)
        system.delete(where, True)
        raise
    if not rename(spark, f"{folder}.marker", _marker(target, name)):
        raise FileExistsError(f"another job has committed {name} to {target}")
    return commit


def published(spark: SparkSession, target: str, schema: str | T.StructType, form: str = "parquet") -> DataFrame:
    """The rows of all commits; none of what is not committed, and no rows where there is no commit."""
    found = [c.folder for c in commits(spark, target)]
    return spark.read.format(form).schema(schema).load(found) if found else spark.createDataFrame([], schema)


def is_published(spark: SparkSession, target: str, name: str = "all") -> bool:
    return any(c.id == name for c in commits(spark, target))


def write_back(rows: DataFrame, source: str, target: str, form: str = "json", **columns: Column) -> Commit:
    """Documents read from `source` with more columns, published at another place: what is being read is never overwritten."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target is the source")
    return publish(rows.withColumns(columns), target, form=form)
