"""Stability of polled counts, and notifications that come once for each key; as batch and as streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def stable_runs(polls: DataFrame, key: str, order: str, count: str, least: int, times: int) -> DataFrame:
    """Polls with `run` (how often the count has been the same, this poll included) and `ready`: the first poll of a key with at least `least` and a run of `times`."""
    w = W.partitionBy(key).orderBy(order)
    change = F.when(F.lag(count).over(w).eqNullSafe(F.col(count)), 0).otherwise(1)
    island = polls.withColumn("__c", change).withColumn("__i", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = island.withColumn("run", F.row_number().over(W.partitionBy(key, "__i").orderBy(order)).cast("int"))
    hit = (F.col(count) >= least) & (F.col("run") == times)
    first = F.sum(F.when(hit, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return run.withColumn("__h", hit).withColumn("__f", first).withColumn("ready", F.col("__h") & (F.col("__f") == 1)).drop("__c", "__i", "__h", "__f")


def stable_stream(polls: DataFrame, key: str, order: str, count: str, least: int, times: int) -> DataFrame:
    """The ready polls (key, at, count) of a streaming table of polls, one for each key; a key's state is its last count, its run and whether it has fired."""

    def each(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        last, run, fired = state.get if state.exists else (None, 0, False)
        out = []
        for row in pd.concat(list(parts)).sort_values(order).itertuples():
            now = int(getattr(row, count))
            run = run + 1 if now == last else 1
            last = now
            if not fired and now >= least and run >= times:
                fired = True
                out.append((name[0], getattr(row, order), now))
        state.update((last, run, fired))
        yield pd.DataFrame(out, columns=["key", "at", "count"])

    kind, at = polls.schema[key].dataType.simpleString(), polls.schema[order].dataType.simpleString()
    return polls.groupBy(key).applyInPandasWithState(each, f"key {kind}, at {at}, count long", "last long, run int, fired boolean", "append", "NoTimeout")


def once(events: DataFrame, key: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """One row for each key; in a stream with a time column, the state is kept as long as rows may come late."""
    if time and events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
