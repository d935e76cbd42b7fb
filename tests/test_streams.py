"""Published tables and streams: whole commits or none, batches that run again, state over restarts."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tablescope.sources import published, writers
from tablescope.streaming import notify

SCHEMA = "k long, v string"


@pytest.fixture
def place(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex[:6]}"


def seen(spark, target, schema=SCHEMA):
    return sorted(tuple(r) for r in published.published(spark, target, schema).collect())


def test_commits_are_whole_and_once(spark, place):
    target = place("table")
    assert seen(spark, target) == [] and not published.is_published(spark, target)
    rows = spark.createDataFrame([(k, str(k)) for k in range(20)], SCHEMA)
    assert published.publish(rows.where("k < 5"), target, "a").rows == 5
    assert published.publish(rows, target, "a").rows == 5  # the same commit again
    assert published.publish(rows.limit(0), target, "none").rows == 0
    published.publish(rows.where("k >= 5"), target, "b")
    assert [x[0] for x in seen(spark, target)] == list(range(20))
    assert [c.id for c in published.commits(spark, target)] == ["a", "b", "none"]


def test_a_job_that_fails_leaves_nothing(spark, place):
    """Its tasks write some files before one of them fails; no row is seen, and the folder is gone."""
    target = place("table")
    rows = spark.range(0, 1000, 1, 8).select(F.col("id").alias("k"), F.when(F.col("id") == 990, F.raise_error(F.lit("broken"))).otherwise(F.lit("v")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        published.publish(rows, target)
    assert seen(spark, target) == [] and not published.is_published(spark, target)
    system, where = writers.system_of(spark, target)
    assert not system.exists(where) or len(system.listStatus(where)) == 0
    published.publish(rows.where("k < 900"), target)
    assert len(seen(spark, target)) == 900


def test_what_is_not_committed_is_not_seen(spark, place):
    """Rows whose job died between its folder and its marker."""
    target = place("table")
    spark.createDataFrame([(1, "lost")], SCHEMA).write.parquet(f"{target}/_all-0123")
    assert seen(spark, target) == []


def test_write_back_refuses_its_source(spark, place):
    with pytest.raises(ValueError, match="source"):
        published.write_back(spark.range(1), "file:///x/", "file:///x")


EVENTS = "key string, n long"


def test_a_key_is_notified_once_over_runs(spark, place):
    source, checkpoint, target = place("in"), place("state"), place("out")
    for keys in (["a", "b", "a"], ["b", "c"], [], ["a", "d", "d"]):
        spark.createDataFrame([(k, i) for i, k in enumerate(keys)], EVENTS).coalesce(1).write.mode("append").parquet(source)
        notify.notify_once(notify.files_stream(spark, source, EVENTS).select("key"), checkpoint, target)
    found = published.published(spark, target, "key string, batch long").collect()
    assert sorted(r["key"] for r in found) == ["a", "b", "c", "d"]
    first = {r["key"]: r["batch"] for r in found}
    assert first["a"] == first["b"] < first["c"] < first["d"]


def test_a_batch_that_runs_again_counts_once(spark, place, tmp_path):
    """The checkpoint loses the note that the last batch is done, as in a crash behind the sink: the batch runs again."""
    source, checkpoint, target = place("in"), tmp_path / "state", place("out")
    for keys in (["a"], ["b", "c"]):
        spark.createDataFrame([(k, 0) for k in keys], EVENTS).coalesce(1).write.mode("append").parquet(source)
        notify.notify_once(notify.files_stream(spark, source, EVENTS).select("key"), f"file://{checkpoint}", target)
    before = published.published(spark, target, "key string, batch long").collect()
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    notify.notify_once(notify.files_stream(spark, source, EVENTS).select("key"), f"file://{checkpoint}", target)
    assert sorted(published.published(spark, target, "key string, batch long").collect()) == sorted(before)


def test_a_run_of_polls_goes_on_after_a_restart(spark, place):
    source, checkpoint, target = place("in"), place("state"), place("out")
    polls = [[("x", 1, 5), ("x", 2, 7), ("y", 1, 9)], [("x", 3, 7), ("y", 2, 9), ("y", 3, 9)], [("x", 4, 7), ("x", 5, 7), ("y", 4, 9)]]
    for part in polls:
        spark.createDataFrame(part, "name string, at long, files long").coalesce(1).write.mode("append").parquet(source)
        notify.watch_stable(notify.files_stream(spark, source, "name string, at long, files long"), checkpoint, target, "name", "at", "files", 6, 3)
    found = published.published(spark, target, "key string, at long, count long, batch long")
    assert sorted(tuple(r)[:3] for r in found.collect()) == [("x", 4, 7), ("y", 3, 9)]


def test_alerts(spark):
    jobs = spark.createDataFrame([(1, "FAILED"), (2, "COMPLETED"), (3, "RUNNING"), (4, None)], "job long, state string")
    got = notify.alerts(jobs, F.col("state") == "FAILED", F.col("state") == "COMPLETED", "job", "state").select("key", "title").collect()
    assert sorted(map(tuple, got)) == [("bad-1-FAILED", "problem: FAILED"), ("done-2", "completed")]
