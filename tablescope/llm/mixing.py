"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in built-in expressions alone.

Each document gets the exponential key -ln(u) / w, where u in (0, 1) comes from a hash of its id and w is its quality
weight; the documents of the smallest keys are a weighted sample without replacement. A source's target is met by whole
epochs of all its documents first, then by the documents in the order of their keys until the rest of the target is
reached. All of it follows from the rows alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import packed_rows, unpacked_rows, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
_TWO52 = float(1 << 52)


def quality_weight(text: Column) -> Column:
    """0.25 to 1.25: a quarter and the share of letters among the text's characters."""
    return F.lit(0.25) + F.length(F.regexp_replace(text, r"\P{L}+", "")) / F.greatest(F.length(text), F.lit(1))


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """row (a hash of all columns), doc_id, source, size and sampling key of each row; the text goes no further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_TWO52)
    return docs.select(
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"),
        (-F.log(uniform) / (quality_weight(text) if weight is None else weight)).alias("sort_key"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, docs and target of each source.

    The weights repeat over the sources in code point order, null last. `share` of all sizes is dealt out by weight; no
    target exceeds `epochs` times its source's size, and what is over goes to the others by their weights: target =
    least(cap, level * weight), where the level is the first, in the order of cap / weight, that the source at hand does not cap, which is the largest such. The windows
    without a partition run over a row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    per = per.withColumn("w", w).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    per = per.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return per.select("source", "source_size", "docs", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, weight: Column | None = None) -> DataFrame:
    """row, doc_id, size, source, source_size, target, copies and taken (copies * size) for each row.

    A document is taken whole or not: the last one of the fractional epoch is taken if that comes nearer to the target.
    Rows equal in all columns are counted first and come as many again at the end, one by one as far as they are taken, so
    that a row that is there very often is one row in between. A source's rows are ranked in parts of about the square root
    of their number, cut by the logarithms of their keys: whatever the weights are, the density of that logarithm is at most
    1 / e, so that no part has much more than its share, and no task holds a whole source. Null and empty texts have size 0
    and take nothing; a null source is a source; equal keys follow doc_id, then size, then row; no rows, no rows.
    """
    every = sized(docs, weight).groupBy("row", "doc_id", "source", "size", "sort_key").agg(F.count("*").alias("n"))
    sizes = written(every, "sizes")  # read three times: the texts are read once
    per = targets(sizes, weights, share, epochs).withColumn("parts", F.ceil(F.sqrt(F.col("docs").cast("double"))).cast("long"))
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    per = per.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # null-safe equality on the source; a row for each source, as a table, whose size is known: Spark broadcasts it only
    # below its own limit, and then moves no document by its source
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = sizes.withColumn("k", key).join(written(per.withColumn("k", key).drop("source"), "targets"), "k")
    rows = rows.withColumn("part", F.floor(F.log("sort_key") * F.col("parts")).cast("long"))
    # the parts' sums are a table of their own: the square root of a source's rows in number
    sums = written(rows.groupBy("k", "part").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "part-sums")
    before = sums.select("k", "part", F.coalesce(F.sum("words").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_before"))
    inside = W.partitionBy("k", "part").orderBy("sort_key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).join(before, ["k", "part"])
    ahead = F.col("part_before") + F.col("inside")
    one = F.when(ahead + F.col("size") / 2.0 <= F.col("rest"), 1).otherwise(0)
    some = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("rest") - ahead - F.col("size") / 2.0) / F.nullif(F.col("size"), F.lit(0))) + 1))
    taken = F.when((F.col("n") == 1) | (F.col("size") == 0), one * F.col("n")).otherwise(some)
    rows = rows.withColumn("more", F.when(F.col("whole") < epochs, taken).otherwise(0).cast("long")).withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = (F.col("whole") + (F.col("at") <= F.col("more")).cast("long")).cast("long")
    return rows.withColumn("copies", copies).select("row", "doc_id", "size", "source", F.col("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs' columns, each row as often as the mix takes it; rows equal in all columns share what they take together.

    Null and empty texts have no size and come as often as their source's whole epochs and place say; no rows, no rows;
    columns may have any names.
    """
    rows = [F.col(f"`{c}`") for c in docs.columns]
    copies = mix(docs).groupBy("row").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    once = packed_rows(docs, F.xxhash64(*rows).alias("row")).join(copies, "row").dropDuplicates(["row", "doc"])
    return unpacked_rows(once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (0.25 + length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)::DOUBLE) AS sort_key
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM sums),
levels AS (SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS l
  FROM weighed),
aims AS (SELECT source, source_size, least(cap, coalesce((SELECT max(l) FROM levels WHERE l <= cap / w) * w, cap)) AS target FROM levels),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM aims),
ranked AS (
  SELECT s.doc_id, s.size::BIGINT AS size, w.source_size, w.target, w.epochs, w.target - w.epochs * w.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.sort_key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0::DOUBLE AS over
  FROM sized s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN epochs < 2 AND over <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM ranked
"""
