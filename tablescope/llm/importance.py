"""Target-distribution importance resampling in built-in expressions alone.

Texts are bags of hashed word n-grams. A bucket's gain is the logarithm of how much likelier it is in the target texts than
in the corpus, a document's weight is the mean gain of its features, and the documents of the highest weights plus a Gumbel
number each are a sample without replacement in proportion to exp(weight / SCALE).

n-grams are exploded and counted by bucket before anything is shuffled; there are BUCKETS gains at most, whatever the corpus,
and that table is broadcast. Documents meet their gains in the scan, so that only a row a document is shuffled. The ranks are
those of a distributed sort: the rows are ranged by score, and each range's ranks are moved on by the rows of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import CRC32_SQL, partitions, texts, written

BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: All ASCII but digits and letters.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TWO32 = float(1 << 32)


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda w: w != "")


def ngrams(found: Column, upto: int) -> Column:
    """All runs of 1 to `upto` consecutive words, joined by one space."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - (n - 1))
        return F.when(F.size(found) >= n, F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return found if upto == 1 else F.concat(found, *[of(n) for n in range(2, upto + 1)])


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def counts(docs: DataFrame, upto: int, buckets: int) -> DataFrame:
    """bucket and its features n over all rows; a row for each bucket at most."""
    features = docs.select(F.explode(ngrams(words(F.col("text")), upto)).alias("feature"))
    return features.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of the corpus's buckets, from both sides' counts."""
    both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    all_s, all_t = (side.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).scalar() for side in (corpus, target))
    ratio = (F.coalesce("t", F.lit(0)) + F.lit(1.0)) * (all_s + F.lit(float(buckets))) / ((F.col("s") + F.lit(1.0)) * (all_t + F.lit(float(buckets))))
    return both.select("bucket", F.floor(F.lit(float(SCALE)) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A Gumbel number, in SCALE-ths, from a hash of the id alone, so that reruns agree."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-SCALE)) * F.log(-F.log((h + 0.5) / F.lit(_TWO32)))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, upto: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """key, doc_id, n_words, n_features and weight of each row of docs."""
    rows = texts(docs)
    table = gains(written(counts(rows, upto, buckets), "corpus-buckets"), written(counts(texts_of(target), upto, buckets), "target-buckets"), buckets)
    found = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", words(F.col("text")).alias("words"))
    each = found.select("key", "doc_id", F.size("words").alias("n_words"), F.explode_outer(ngrams(F.col("words"), upto)).alias("feature"))
    met = each.withColumn("bucket", bucket(F.col("feature"), buckets)).join(F.broadcast(table), "bucket", "left")
    total = met.groupBy("key", "doc_id", "n_words").agg(F.count("feature").alias("n_features"), F.sum("gain").alias("gain"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))  # the floor, in whole numbers
    return total.select("key", "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_features", weight.cast("long").alias("weight"))


def texts_of(target: DataFrame) -> DataFrame:
    """The target's texts alone; a null one is empty."""
    return target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank, from 1, in the given order: ranges of a distributed sort, each moved on by the rows of those before.

    The ranges are written before they are counted, so that what is counted is what is ranked; a row for each range is all
    that is gathered.
    """
    spark = rows.sparkSession
    ranged = written(rows.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "ranges")
    ahead = ranged.groupBy("range").agg(F.count("*").alias("n"))
    ahead = ahead.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(W.partitionBy("range").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(ahead), "range").withColumn("rank", (F.col("ahead") + F.col("inside")).cast("long")).drop("range", "inside", "ahead")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, upto: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of docs, all long.

    Of the N rows with `least` words at least, floor(percent * N / 100) of the highest scores are drawn; ties go to the smaller
    doc_id, null last, and equal rows are drawn one by one. A null text is empty, has no features and weight 0. Null ids have
    one Gumbel number. An empty target has the same gain in every unseen bucket; no rows, no rows. Columns other than
    doc_id and text are not read.
    """
    weights = weighed(docs, target, upto, buckets)
    rows = written(weights.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    few = rows.where(F.col("n_words") >= least)
    draw = F.coalesce(F.floor(few.agg(F.count("*")).scalar() * percent / F.lit(100)), F.lit(0))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key"))
    inside = ranked(few, *order).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return inside.select(*columns).unionByName(rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")).select(*columns))


OP13_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT rid, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
{CRC32_SQL.format(strings="SELECT DISTINCT word AS s FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)")},
db AS (SELECT rid, crc % 10000 AS b FROM dw JOIN crcs ON word = s),
sc AS (SELECT b, count(*) AS s FROM db GROUP BY 1),
tc AS (SELECT crc % 10000 AS b, count(*) AS t FROM bw JOIN crcs ON word = s GROUP BY 1),
whole AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM bw)::DOUBLE AS t_all),
gains AS (SELECT b, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (t_all + 10000.0::DOUBLE))))::BIGINT AS gain FROM sc LEFT JOIN tc USING (b), whole),
weights AS (SELECT rid, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM db JOIN gains USING (b) GROUP BY rid),
scored AS (SELECT rid, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weights USING (rid)),
places AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN places USING (rid)
"""
