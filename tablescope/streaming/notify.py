"""Streams that run until they have seen what is there, and go on where they stopped: notifications once for each key, and stable polls.

Spark's checkpoint keeps the files that were read and the state of each key. What a batch finds is published under the batch's
number, so that a batch that is run again after a crash is not seen twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.published import is_published, publish
from . import polls


def files_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", files: int | None = None) -> DataFrame:
    """A folder's files as a stream, each once; `files` at most in a batch."""
    reader = spark.readStream.format(form).schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def run_available(found: DataFrame, checkpoint: str, target: str, mode: str = "append", change: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Runs a stream over what there is, and publishes each batch that has rows under its number; the next run with this checkpoint goes on from there."""

    def put(batch: DataFrame, number: int) -> None:
        rows, name = change(batch, number) if change else batch, f"{number:012d}"
        if is_published(batch.sparkSession, target, name):
            rows.write.format("noop").mode("append").save()  # seen already, but the keys' state is still to be kept
        else:
            publish(rows.withColumn("batch", F.lit(number).cast("long")), target, name)

    query = found.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


def alerts(jobs: DataFrame, failed: Column, finished: Column, job: str, state: str) -> DataFrame:
    """key and title of jobs (job, state) that failed, once for each state, or finished."""
    key = F.when(failed, F.concat_ws("-", F.lit("bad"), F.col(job).cast("string"), F.col(state))).when(finished, F.concat_ws("-", F.lit("done"), F.col(job).cast("string")))
    title = F.when(failed, F.concat(F.lit("problem: "), F.col(state))).otherwise(F.lit("completed"))
    return jobs.withColumns({"key": key, "title": title}).where("key IS NOT NULL")


def notify_once(found: DataFrame, checkpoint: str, target: str, key: str = "key", time: str | None = None, late: str = "1 day") -> None:
    """Publishes the first row of each key of a stream, over all runs with this checkpoint.

    Without a time column a key is known for ever, as its state is; with one it is known as long as rows may come late.
    """
    run_available(polls.once(found, key, time, late), checkpoint, target)


def watch_stable(found: DataFrame, checkpoint: str, target: str, key: str, order: str, count: str, least: int, times: int) -> None:
    """Publishes the first poll of each key at which its count has been the same `times` times and is `least` or more; a run may go on from one run of the stream to the next."""
    run_available(polls.stable_stream(found, key, order, count, least, times), checkpoint, target)
