"""Spelling variant grouping: words one edit apart, by a rare-first prefix filter over positional bigrams.

A word's bigrams are put in one global order, the rarest in the vocabulary first. One edit touches two bigrams of a word at
most, and leaves the others in their order, either at their places or, behind an insertion, one place further on. So two words
that are one edit apart share one of the THREE rarest bigrams of each, at the same place if they are equally long, else at
the same place or one further on in the longer word (position and length limits). The edit is on one side of that bigram, so
that what stands on the other side is equal too. Words meet by a hash of bigram, place, length and that side, where it is short
also of one half of the edited side, and what meets is verified by the edit distance itself: the result is that of comparing all pairs.

Occurrences are added up before they are shuffled, so that a very frequent word is one row a task. Bigrams of an alphabet of
90 letters are 8,100 at most; their frequencies are all that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC32_SQL, texts, written

SHORTEST = 6
LEAST = 5
RATIO = 5
#: An edit changes two bigrams of a word at most, so that the third rarest at the latest is shared.
THREE = 3
#: A side of a bigram of fewer letters is shared by many words.
SHORT = 3
#: Words in a file of an intermediate table. Every file costs processes that set its rights, which hold a JVM's memory a second time while they start.
FILE_WORDS = 250_000
DAMAGE = 199
#: Anything but letters; upper case A-Z has been folded.
GAP = "[^a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(run: Column, doc_id: Column, every: int = DAMAGE) -> Column:
    """run without one letter where `every` divides its hash, which follows from the document and the run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int | None = DAMAGE) -> DataFrame:
    """word and n of all words of `shortest` letters and `least` occurrences; runs that are too short cannot become words."""
    runs = texts(docs).select("doc_id", F.explode(F.split(F.translate("text", UPPER, LOWER), GAP)).alias("run")).where(F.length("run") >= shortest)
    words = runs.select((damaged(F.col("run"), F.col("doc_id"), every) if every else F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rarest(words: DataFrame) -> DataFrame:
    """id, word, n and the THREE rarest bigrams (gram, at) of each word of words (id, word, n)."""
    letters = words.select("id", "word", "n", F.split("word", "").alias("letters"))
    pairs = F.transform(F.slice("letters", 1, F.size("letters") - 1), lambda c, i: F.concat(c, F.get("letters", i + 1)))
    grams = letters.select("id", "word", "n", F.posexplode(pairs).alias("at", "gram"))
    seen = grams.groupBy("gram").agg(F.count("*").alias("seen"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("seen", "gram", "at"))), 1, THREE)
    few = grams.join(F.broadcast(seen), "gram").groupBy("id", "word", "n").agg(first.alias("few"))
    return few.select("id", "word", "n", F.inline("few")).select("id", "word", "n", "gram", "at")


def meetings(less: int) -> Column:
    """Names of the places where a word (word, gram, at) meets words that have `less` letters less: one for each part that the edit may have left alone.

    The bigram, its place, the length, and the side of the bigram that is equal. A side of under SHORT letters says little, so
    that one half of the other side, as the shorter word has it, is added: the edit is in one half and leaves the other alone.
    """
    size, at, word = F.length("word"), F.col("at"), F.col("word")
    ahead, behind = F.left(word, at), F.substring(word, at + 3, size)

    def key(side: int, place: Column, *parts: Column) -> Column:
        return F.xxhash64(F.col("gram"), place, size - less, F.lit(side), *parts)

    def names(side: int, place: Column, equal: Column, other: Column) -> Column:
        n = F.length(other) - less
        half = F.floor(n / 2).cast("int")
        return F.when(F.length(equal) >= SHORT, F.array(key(side, place, equal))).otherwise(F.array(key(side + 2, place, equal, F.left(other, half)), key(side + 4, place, equal, F.right(other, n - half))))

    return F.concat(names(0, at, ahead, behind), names(1, at - less, behind, ahead))


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of words (id, word, n) that are one edit apart: a_id, a_word, a_n, b_id, b_word, b_n, each pair once."""
    few = rarest(words)
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("id", "word", "n")]
    keys = few.select(F.explode(meetings(0)).alias("key"), *side("b"))
    ways = F.array(*(F.struct(F.lit(less).alias("less"), meetings(less).alias("keys")) for less in (0, 1)))
    asking = few.select(*side("a"), F.inline(ways)).select(F.explode("keys").alias("key"), *(f"a_{c}" for c in ("id", "word", "n")), "less")
    met = asking.join(keys, "key").where((F.col("less") == 1) | (F.col("a_id") < F.col("b_id")))
    return met.where(F.levenshtein("a_word", "b_word", 1) == 1).drop("key", "less").distinct()


def related(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form and form_n of all words (word, n): the near words and, of these, the most frequent one (ties: the smallest) if it is `ratio` times as frequent."""
    named = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    both = F.array(*(F.struct(F.col(f"{a}_id").alias("id"), F.col(f"{b}_word").alias("word"), F.col(f"{b}_n").alias("n")) for a, b in ("ab", "ba")))
    sides = near_pairs(named).select(F.inline(both)).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "word")).alias("best"))
    rows = named.join(sides, "id", "left")
    best_n = -F.col("best.less")
    formed = best_n >= F.col("n") * ratio
    found = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, best_n).alias("form_n"))
    return written(found, "variants", files(named))


def files(words: DataFrame) -> int:
    """How many files a row for each word takes: few for few words, whatever the number of partitions is."""
    return words.count() // FILE_WORDS + 1


def roots(words: DataFrame) -> DataFrame:
    """word and root of all words (word, form) with a form: forms are followed to the last.

    Each round lets a word take the root that its root has, so that chains are halved. A form is more frequent than its word, so
    that there is no circle, and with a ratio of 5 a chain of counts under 2 ** 63 has 27 words at most: five rounds.
    """
    some = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    few = files(some)
    chain = written(some, "forms", few)
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        further = chain.join(onward, "root", "left")
        if further.where("onward IS NOT NULL").isEmpty():
            return chain
        chain = written(further.select("word", F.coalesce("onward", "root").alias("root")), "forms", few)


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words (word, n), which are distinct.

    No words, no rows. A word without a near word has n_near 0, no form, and is its own root.
    """
    rows = related(words, ratio)
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, every: int | None = DAMAGE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of all texts of docs.

    A null text has no words; a null doc_id counts as the empty text in the hash; repeated rows count as often as they come;
    no rows, no words. Columns other than doc_id and text are not read. every=None leaves all runs as they are. Words of under
    four letters can be one edit apart without a bigram in common: a smaller `shortest` is an error.
    """
    if shortest < THREE + 1:
        raise ValueError(f"words need {THREE + 1} letters at least")
    return grouped(counted(docs, shortest, least, every), ratio)


OP11_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
long_runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
{CRC32_SQL.format(strings="SELECT id AS s FROM long_runs")},
left_over AS (SELECT times, CASE WHEN crc % 199 = 0 THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word FROM long_runs JOIN crcs ON id = s),
words AS (SELECT word, sum(times)::BIGINT AS n FROM left_over WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
holes AS (SELECT word, n, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
replaced AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM holes a JOIN holes b ON a.l = b.l AND a.r = b.r AND a.word <> b.word),
deleted AS (SELECT DISTINCT h.word AS longer, h.n AS longer_n, w.word AS shorter, w.n AS shorter_n FROM holes h JOIN words w ON h.l || h.r = w.word),
near AS (SELECT a, b, n FROM replaced UNION ALL SELECT longer, shorter, shorter_n FROM deleted UNION ALL SELECT shorter, longer, longer_n FROM deleted),
best AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS nth FROM near),
formed AS (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON a = word AND nth = 1),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)
"""
