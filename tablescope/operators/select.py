"""Selections for review: bands, caps, fill-ups, samples by hash, outer rows first; and a lint over files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_SHAPE = 999


def shaped(rows: DataFrame, bounds: Mapping[str, tuple[int | None, int | None]]) -> DataFrame:
    """Rows whose columns lie within bounds, ends included; null bounds do not bind."""
    for c, (low, high) in bounds.items():
        if low is not None:
            rows = rows.where(F.col(c) >= low)
        if high is not None:
            rows = rows.where(F.col(c) <= high)
    return rows


def band(rows: DataFrame, column: str, low: float, high: float, closed: bool = False) -> DataFrame:
    return rows.where((F.col(column) >= low) & ((F.col(column) <= high) if closed else (F.col(column) < high)))


def near_target(rows: DataFrame, column: str, target: float, k: int, low: float, high: float, caps: Mapping[str, int]) -> DataFrame:
    """The k rows of a closed band nearest to a target, smaller tables first; a missing size counts as very large."""
    some = band(rows, column, low, high, closed=True)
    for c, most in caps.items():
        some = some.where(F.coalesce(c, F.lit(MISSING_SHAPE)) <= most)
    return some.orderBy(F.abs(F.col(column) - target), *(F.coalesce(c, F.lit(MISSING_SHAPE)) for c in caps), "sample").limit(k)


def sample_by_hash(rows: DataFrame, key: str, k: int, seed: int = 42, without: DataFrame | None = None) -> DataFrame:
    """k rows in the order of a hash of the key, none of them in the other table: the same in every run."""
    some = rows if without is None else rows.join(without.select(key).distinct(), key, "left_anti")
    return some.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(k)


def filled_up(parts: Sequence[DataFrame], key: str, k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows of several selections, earlier ones first, each key once."""
    out = None
    for n, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(n))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy(key).agg(F.min("__part").alias("__part"))
    return out.join(first, [key, "__part"]).orderBy("__part", *order).limit(k).drop("__part")


def problems_first(rows: DataFrame, empty: Column, defects: Column, key: str) -> DataFrame:
    return rows.orderBy(F.when(empty, 0).otherwise(1), F.desc(defects), key)


def low_confidence(regions: DataFrame, k: int) -> DataFrame:
    """The k least sure regions of each sample; a missing score counts as sure and is shown as 0."""
    from .scores import top_per_group

    ranked = top_per_group(regions.withColumn("__s", F.coalesce("score", F.lit(1.0))), "sample", [F.asc("__s"), F.asc("region_idx")], k)
    return ranked.withColumn("score", F.coalesce("score", F.lit(0.0))).drop("__s")


def visible_sample(rows: DataFrame, document: str, flagged: DataFrame, key: str, k: int, include: bool = False, seed: int = 42) -> DataFrame:
    """k rows, by the order of a hash, of documents that are not flagged, or, `include`, of flagged ones alone."""
    some = rows.join(flagged.select(document).distinct(), document, "left_semi" if include else "left_anti")
    return sample_by_hash(some, key, k, seed)


def require_count(rows: DataFrame, n: int) -> DataFrame:
    if (found := rows.count()) != n:
        raise ValueError(f"{found} rows, not {n}")
    return rows


def lint(files: DataFrame, patterns: Mapping[str, str], suffixes: Sequence[str] = (), most_bytes: int | None = None) -> DataFrame:
    """path and rule of each violation, from binary files (path, length, content): patterns in the text, unwanted suffixes, and size."""
    text = F.col("content").cast("string")
    rules = [F.when(text.rlike(regex), name) for name, regex in patterns.items()]
    rules += [F.when(F.lower("path").endswith(s), f"suffix {s}") for s in suffixes]
    if most_bytes is not None:
        rules.append(F.when(F.col("length") > most_bytes, "size"))
    return files.select("path", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
