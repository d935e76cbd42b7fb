"""URL filters: exact membership of hosts and rules in a cascade of Bloom filters, in built-in expressions alone.

Every key that any url of the corpus can ask for is known beforehand: its host, and each of the last labels of its host with
the beginnings of its path that are as long as some rule's. The distinct keys are the universe. The first level of the
cascade encodes the listed keys of the universe, the second those unlisted keys that the first takes for listed, the third
those listed keys that the second takes for unlisted, and so on until a level has no false positive. A key's first level that
does not hold it says whether it is listed, without an error for any key of the universe.

The levels' bits are a table of one row a level, read by scalar subqueries, so that urls are judged in the scan: no join, no
shuffle. A cascade that would exceed MOST_BITS is not sent to the executors; there the same keys meet the listed ones in a
shuffled join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host is listed if one of these is a part of a label, between dots and hyphens.
TERMS = ("ads", "adult", "bets", "casino", "pills", "spam")
#: Bits of all levels that may be sent to every executor: 8 MB.
MOST_BITS = 1 << 26
#: Hash functions of the levels after the first, which each leave 2 ** -LATER false positives.
LATER = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a url; both empty where it is null or has no ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def has_term(host: Column, terms: tuple[str, ...] = TERMS) -> Column:
    return F.rlike(host, F.lit(f"(^|[.-])({'|'.join(terms)})($|[.-])"))


def candidates(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> list[tuple[Column, int]]:
    """(rule, labels) of each rule that could fit: as many of the host's last labels and as much of the path as some rule has."""
    return [
        (F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, size)), labels)
        for labels in sorted({r[1].count(".") + 1 for r in rules}) for size in sorted({len(r[2]) for r in rules})
    ]


@dataclass
class Level:
    """Bits, hash functions and number of a level, whose words stand in a row of the table at `path`."""

    bits: int
    hashes: int
    number: int
    path: str


@dataclass
class Cascade:
    """Exact membership of the universe's keys: which are listed."""

    levels: list[Level]
    keys: DataFrame

    def contains(self, key: Column) -> Column:
        first, second = identity(key)
        found = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            words = self.keys.sparkSession.read.schema("words array<bigint>").parquet(level.path).select("words").scalar()
            found = F.when(hit(words, places(first, second, level)), found).otherwise(F.lit(level.number % 2 == 1))
        return found


def identity(key: Column) -> tuple[Column, Column]:
    """128 bits of a key: all levels hash these."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def places(first: Column, second: Column, level: Level) -> list[Column]:
    """The bits of a key in a level."""
    start = F.pmod(F.xxhash64(first, second, F.lit(level.number)), F.lit(level.bits).cast("long"))
    step = F.pmod(F.xxhash64(second, first, F.lit(level.number)), F.lit(level.bits - 1).cast("long")) + 1
    return [(start + step * i) % level.bits for i in range(level.hashes)]


def hit(words: Column, at: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in at])


def filled(keys: DataFrame, level: Level) -> DataFrame:
    """One row: the words of a level that encodes all keys. There are bits / 64 words, whatever the keys are."""
    first, second = identity(F.col("key"))
    at = keys.select(F.explode(F.array(*places(first, second, level))).alias("at"))
    ones = at.select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("ones"))
    zeros = keys.sparkSession.range(level.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("ones"))
    words = ones.unionByName(zeros).groupBy("word").agg(F.bit_or("ones").alias("ones"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "ones"))), lambda s: s["ones"]).alias("words"))


def cascade(universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade | None:
    """The cascade over the distinct keys of universe (key, listed); None if it would exceed most_bits.

    Without listed keys it has no level and holds nothing. A level has 1.44 bits a key and hash function; the first has as
    many hash functions as leave about as many false positives as there are listed keys, the later ones LATER, so that each has
    a sixteenth of the keys of the last but one. Each level's false positives are written: they are the next one's keys.
    """
    keys = written(universe, "url-keys")
    inside, outside = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
    count, others = inside.count(), outside.count()
    levels: list[Level] = []
    spent = 0
    while count:
        hashes = LATER if levels else max(1, round(math.log2(max(2.0, others / count))))
        bits = max(128, 64 * math.ceil(hashes * count / math.log(2) / 64))
        spent += bits
        if spent > most_bits:
            return None
        level = Level(bits, hashes, len(levels), "")
        table = written(filled(inside, level), f"url-level-{level.number}")
        level.path = table.inputFiles()[0].rsplit("/", 1)[0]
        levels.append(level)
        first, second = identity(F.col("key"))
        words = table.scalar()
        wrong = written(outside.where(hit(words, places(first, second, level))), f"url-wrong-{level.number}")
        inside, outside = wrong, inside
        count = inside.count()
    return Cascade(levels, keys)


def universe(urls: DataFrame, rules: tuple[tuple[str, str, str], ...], listed: DataFrame | None) -> DataFrame:
    """key and listed: all different keys of the urls (host, path). Keys are tagged: r for a rule, a for one that allows, h for a host."""
    fits = candidates(F.col("host"), F.col("path"), rules)
    asked = F.array(*[F.concat(F.lit(tag), c) for c, _ in fits for tag in ("r ", "a ")], F.concat(F.lit("h "), F.col("host")))
    keys = urls.select(F.explode(asked).alias("key")).distinct()
    ruled = [f"r {h}{p}" for _, h, p in rules] + [f"a {h}{p}" for v, h, p in rules if v == "allow"]
    host = F.startswith(F.col("key"), F.lit("h "))
    if listed is None:
        return keys.withColumn("listed", F.when(host, has_term(F.substring("key", 3, 1 << 30))).otherwise(F.col("key").isin(ruled)))
    hosts = listed.select(F.concat(F.lit("h "), F.translate(F.col("host").cast("string"), UPPER, LOWER)).alias("key")).where("key IS NOT NULL").distinct().withColumn("of_list", F.lit(True))
    return keys.join(hosts, "key", "left").select("key", F.when(host, F.coalesce("of_list", F.lit(False))).otherwise(F.col("key").isin(ruled)).alias("listed"))


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, listed: DataFrame | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    A rule (verdict, host, path) fits its host and all subdomains of it where the url's path starts with the rule's; the
    longest that fits gives the verdict, of equally long ones that with more labels. Where none fits, a listed host is
    blocked, any other allowed: those of listed (host), or else those of the corpus with one of TERMS in a label. A null url
    or one without :// has an empty host and path; repeated rows get equal results; no rows, no rows. Two rules of one host and
    path that differ in their verdicts are an error. Columns other than page_id and url are not read.
    """
    if len({r[1:] for r in rules}) < len(set(rules)):
        raise ValueError("two rules of one host and path differ in their verdicts")
    host, path = parts(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    found = cascade(universe(urls, rules, listed), most_bits)
    if found is None:
        return by_join(urls, written(universe(urls, rules, listed).where("listed").select("key"), "url-listed"), rules)
    fits = [F.when(found.contains(F.concat(F.lit("r "), c)), F.struct(F.length(c).alias("size"), F.lit(labels).alias("labels"), c.alias("rule"))) for c, labels in candidates(F.col("host"), F.col("path"), rules)]
    best = fits[0] if len(fits) == 1 else F.greatest(*fits) if fits else F.lit(None).cast("struct<size:int,labels:int,rule:string>")
    rows = urls.withColumn("rule", best["rule"])
    return rows.withColumn("verdict", verdict(found.contains(F.concat(F.lit("a "), F.col("rule"))), found.contains(F.concat(F.lit("h "), F.col("host")))))


def verdict(allowed: Column, listed: Column) -> Column:
    return F.when(F.col("rule").isNotNull(), F.when(allowed, "allow").otherwise("block")).otherwise(F.when(listed, "block").otherwise("allow"))


def by_join(urls: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """The same by a join of all keys asked for with the listed ones, however many there are."""
    rows = urls.withColumn("row", F.monotonically_increasing_id())
    asked = [F.struct(F.concat(F.lit("r "), c).alias("key"), F.length(c).alias("size"), F.lit(labels).alias("labels"), c.alias("rule")) for c, labels in candidates(F.col("host"), F.col("path"), rules)]
    none = F.lit(None).cast("string")
    asked.append(F.struct(F.concat(F.lit("h "), F.col("host")).alias("key"), F.lit(0).alias("size"), F.lit(0).alias("labels"), none.alias("rule")))
    met = rows.select("row", "page_id", "host", "path", F.inline(F.array(*asked))).join(listed.withColumn("there", F.lit(True)), "key", "left")
    best = F.max(F.when(F.col("there") & F.col("rule").isNotNull(), F.struct("size", "labels", "rule")))
    each = met.groupBy("row", "page_id", "host", "path").agg(best["rule"].alias("rule"), F.max(F.coalesce(F.col("there") & F.col("rule").isNull(), F.lit(False))).alias("of_list"))
    allowing = [f"{h}{p}" for v, h, p in rules if v == "allow"]
    return each.select("page_id", "host", "path", "rule", verdict(F.col("rule").isin(allowing), F.col("of_list")).alias("verdict"))


def _sql() -> str:
    values = ", ".join(f"({v!r}, {h!r}, {p!r})" for v, h, p in RULES)
    return f"""
WITH rests AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM rests),
urls AS (SELECT page_id, rid, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
rules(verdict, host, path) AS (VALUES {values}),
fits AS (SELECT rid, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS nth
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(TERMS)})($|[.-])') THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE nth = 1) USING (rid)
"""


OP12_SQL = _sql()
