"""Key audits, unions with checks, first and last wins, positional joins, shards and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def require_all(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises with up to five keys of the left side that the right side lacks."""
    if found := [r[0] for r in unmatched(left, right, key).select(key).limit(5).collect()]:
        raise ValueError(f"missing {key}: {found}")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    if found := [r[0] for r in duplicates(rows, key).limit(5).collect()]:
        raise ValueError(f"repeated {key}: {found}")
    return rows


def union_disjoint(parts: Sequence[DataFrame], key: str) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return require_unique(out, key)


def union_shards(rows: DataFrame, shard: str, expected: int) -> DataFrame:
    """The rows of all shards; raises if one of 0 .. expected - 1 has none."""
    there = {r[0] for r in rows.select(shard).distinct().collect()}  # a number for each shard
    if lost := sorted(set(range(expected)) - there):
        raise ValueError(f"shards without rows: {lost[:5]}")
    return rows.drop(shard)


def key_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on either side, on both, and repeated ones, as one row."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("a") > 1).alias("repeated_left"), F.count_if(F.col("b") > 1).alias("repeated_right")
    )


def first_wins(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def positional_join(a: DataFrame, b: DataFrame, key: str, values: str) -> DataFrame:
    """Elements of two arrays of the same place, as far as the shorter goes: key, place, a, b."""
    left = a.select(key, F.posexplode(values).alias("place", "a"))
    right = b.select(key, F.posexplode(values).alias("place", "b"))
    return left.join(right, [key, "place"])


def merged(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a; a column that b has too takes b's value where there is one."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    more = [c for c in b.columns if c not in a.columns]
    other = b.select(key, *(F.col(c).alias(f"__{c}") for c in shared), *more)
    joined = a.join(other, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in shared else F.col(c) for c in a.columns), *more)


def with_status(a: DataFrame, b: DataFrame, key: str, missing: str = "missing_prediction") -> DataFrame:
    joined = a.join(b.withColumn("__there", F.lit(True)), key, "left")
    return joined.withColumn("status", F.when(F.col("__there"), "evaluated").otherwise(missing)).drop("__there")


def numbered(rows: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """`index` from 0 over a total order, and the number of rows `of`, in ranges of the order, so that no task holds all rows. Nulls come first."""
    placed = cumulated(rows, [], [F.asc(c) for c in order], F.lit(1).cast("long"), parts)
    return placed.withColumnRenamed("ahead", "index")


def cumulated(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: Column, parts: int | None = None) -> DataFrame:
    """Rows with `ahead`, the sum of n over the rows of their group that come before, and `of`, the sum over the group.

    The rows are ranged by group and order and written, so that a group of any size is spread over many ranges, and what is
    counted is what is there. A row for each range and group is all that the sums over a group's ranges see. The order is total
    within a group; null groups are groups.
    """
    names = list(group)
    parts = parts or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows.withColumn("__n", n).repartitionByRange(parts, *names, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("__range", *names).agg(F.sum("__n").alias("__sum"))
    whole = W.partitionBy(*names)
    before = F.coalesce(F.sum("__sum").over(whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("__range").alias("__r"), *[F.col(f"`{c}`").alias(f"__g{k}") for k, c in enumerate(names)], before.alias("__before"), F.sum("__sum").over(whole).alias("of"))
    inside = F.sum("__n").over(W.partitionBy("__range", *names).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    same = F.col("__range") == F.col("__r")
    for k, c in enumerate(names):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__g{k}"))
    placed = ranged.withColumn("__inside", inside).join(per, same)
    return placed.withColumn("ahead", F.col("__inside") + F.col("__before")).select(*[F.col(f"`{c}`") for c in rows.columns], "ahead", "of")


def modulo_shard(index: Column, shards: int) -> Column:
    return F.pmod(index, F.lit(shards)).cast("int")


def batch_of(index: Column, size: int) -> Column:
    """Batches of `size` neighbours; the last one may be smaller."""
    return F.floor(index / size).cast("long")


def range_shard(index: Column, of: Column, shards: int) -> Column:
    """Contiguous shards; shard i ends at floor((i + 1) * of / shards)."""
    return F.floor(((index + 1) * shards - 1) / of).cast("int")


def document_split(rows: DataFrame, document: str, fraction: float, seed: int = 42) -> DataFrame:
    """document, n and split of each document: whole documents, in the order of a hash, until the validation part is full.

    The rank runs over a row for each document, cut into 4,096 ranges of the hash so that no task holds them all.
    """
    per = rows.groupBy(document).agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(document).cast("string")), 256)).withColumn("range", F.substring("h", 1, 3))
    before = per.groupBy("range").agg(F.sum("n").alias("rows")).select("range", F.coalesce(F.sum("rows").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(W.partitionBy(F.lit(0))).alias("total"))
    inside = F.sum("n").over(W.partitionBy("range").orderBy("h")) - F.col("n")
    placed = per.withColumn("inside", inside).join(F.broadcast(before), "range")
    return placed.select(document, "n", F.when(F.col("before") + F.col("inside") < F.bround(F.col("total") * F.lit(fraction)), "validation").otherwise("train").alias("split"))


def replay_mix(sources: Sequence[tuple[DataFrame, str, int]], key: str, seed: int = 42) -> DataFrame:
    """n rows of each source by the order of a hash, with keys prefixed by the source's name; names must differ."""
    out = None
    for rows, name, n in sources:
        some = rows.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:{name}:"), F.col(key).cast("string")), 256)).orderBy("__h", key).limit(n).drop("__h")
        some = some.withColumn(key, F.concat(F.lit(f"{name}__"), F.col(key).cast("string"))).withColumn("source_dataset", F.lit(name))
        out = some if out is None else out.unionByName(some)
    return out


def latest(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """The path of the highest number that the pattern's first group finds."""
    step = F.expr(f"try_cast(regexp_extract({path}, '{pattern}', 1) AS bigint)")
    return rows.withColumn("step", step).where("step IS NOT NULL").agg(F.max_by(path, F.struct("step", path)).alias("path"), F.max("step").alias("step"))


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split, by the splits."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), "+").alias("splits")).where(F.col("splits").contains("+")).groupBy("splits").agg(F.count("*").alias("keys"))


def gate(rows: DataFrame, test: Column, message: str) -> DataFrame:
    """The rows, if the test holds for their aggregate; else an error."""
    if not rows.agg(test.alias("ok")).first()["ok"]:
        raise ValueError(message)
    return rows


def last_wins(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key by an order, as a later entry of a map replaces an earlier one. Where that hides a mistake, `require_unique` raises instead."""
    return first_wins(rows, key, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def updated(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of all tables, of each key those of the last table that has it."""
    every = None
    for n, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(n))
        every = part if every is None else every.unionByName(part)
    last = every.groupBy(key).agg(F.max("__part").alias("__part"))
    return every.join(last, [key, "__part"]).drop("__part")


def union_keys(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The different keys of all tables."""
    out = parts[0].select(key)
    for part in parts[1:]:
        out = out.union(part.select(key))
    return out.distinct()


def prefixed(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """The columns but the key with a prefix, to stand beside another source's."""
    return rows.select(key, *(F.col(c).alias(f"{prefix}{c}") for c in rows.columns if c != key))


def side_by_side(parts: Sequence[tuple[DataFrame, str]], key: str, how: str = "inner") -> DataFrame:
    """Several tables by the keys that all have (or the first has, `left`), each one's columns under its prefix."""
    out = None
    for rows, prefix in parts:
        rows = prefixed(rows, key, prefix)
        out = rows if out is None else out.join(rows, key, how)
    return out


def joined_and_unmatched(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the left side's keys without a partner."""
    return left.join(right, key), unmatched(left, right, key).select(key).distinct()


def after_last(text: Column, separator: str) -> Column:
    """What follows the last separator; the whole text without one."""
    return F.substring_index(text, separator, -1)


def after_first(text: Column, separator: str) -> Column:
    """What follows the first separator; the whole text without one."""
    at = F.instr(text, separator)
    return F.when(at > 0, F.substring(text, at + len(separator), F.length(text))).otherwise(text)


def derived_key_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "inner") -> DataFrame:
    """Rows whose keys, computed on either side, are equal; the key stays as `join_key`."""
    return left.withColumn("join_key", left_key).join(right.withColumn("join_key", right_key), "join_key", how)


def only_named(rows: DataFrame, names: DataFrame, key: str, denied: bool = False) -> DataFrame:
    """The rows whose key is in the list, or, `denied`, is not."""
    return rows.join(names.select(key).distinct(), key, "left_anti" if denied else "left_semi")


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The different keys in the order of their first places."""
    return rows.groupBy(key).agg(F.min(position).alias(position)).orderBy(position, key)


def page(rows: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows of a total order from an offset on; a limit of 0 or less means all of them."""
    some = rows.orderBy(*order).offset(max(0, offset))
    return some.limit(limit) if limit > 0 else some


def first_accepted(rows: DataFrame, test: Column, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows, in order, whose test holds."""
    return rows.where(test).orderBy(*order).limit(n)


def replaced(rows: DataFrame, column: str, source: Column, name: str) -> DataFrame:
    """A column replaced, its old value kept as original_<column>, and where the new one comes from."""
    return rows.withColumn(f"original_{column}", F.col(column)).withColumn(column, source).withColumn(f"{column}_source", F.lit(name))


def text_or_fallback(new: Column, old: Column, fallback: bool = True) -> Column:
    """struct(text, from_new, empty): the new text, or, where it is null or blank and that is allowed, the old one."""
    has = F.trim(F.coalesce(new, F.lit(""))) != ""
    text = F.when(has, new).otherwise(F.coalesce(old, F.lit("")) if fallback else F.lit(""))
    return F.struct(text.alias("text"), has.alias("from_new"), (F.trim(text) == "").alias("empty"))
