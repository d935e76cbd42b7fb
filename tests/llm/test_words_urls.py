"""Variants, URL filters and importance resampling against brute force on small fixtures, with their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescope.llm import common, importance, url_filter, variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def small(spark):
    """Words that differ by one edit, frequent and rare ones, nulls, empty and long texts, repeated rows, clashing columns."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéÿ×A") for _ in range(rng.randint(5, 9))) for _ in range(25)]

    def word() -> str:
        w = stems[min(rng.randint(0, 24), rng.randint(0, 24))]
        k, how = rng.randrange(len(w)), rng.random()
        return w if how < 0.6 else w[:k] + w[k + 1 :] if how < 0.7 else w[:k] + rng.choice("abé") + w[k:] if how < 0.8 else w[:k] + rng.choice("abé") + w[k + 1 :]

    texts = [" ".join(word() + rng.choice(["", ",", " 1", "ł"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += [None, "", " \n", "x" * 5000, ("y" * 3000 + " ") * 5, " ".join(word() for _ in range(3000))]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, 1), (7, texts[5], "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("key", F.lit(2)).withColumn("id", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def variants_by_force(rows: list[tuple[int | None, str | None]], shortest: int, least: int, ratio: int, every: int | None) -> list[tuple]:
    seen: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v is not None and words[v] >= ratio * words[w] else None for w, v in best.items()}
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize(("shortest", "least", "ratio", "every"), [(6, 5, 5, 199), (6, 5, 5, 3), (4, 1, 2, None), (4, 2, 1.5, 2)])
def test_variants_equal_brute_force(small, shortest, least, ratio, every):
    want = variants_by_force([tuple(r) for r in small.select("doc_id", "text").collect()], shortest, least, ratio, every)
    got = sorted(tuple(r) for r in variants.variants(small, shortest, least, ratio, every).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == want and any(w[1] for w in want)


def test_variants_of_nothing(empty):
    assert variants.variants(empty).count() == 0
    with pytest.raises(ValueError, match="letters"):
        variants.variants(empty, shortest=3)


def test_forms_are_followed_to_the_last(spark):
    """A chain of words, each six times as frequent as the one before, longer than one round of halving follows."""
    chain = ["aaaaaaaa"[:k] + "bbbbbbbb"[k:] for k in range(9)]
    words = spark.createDataFrame([(w, 6**k) for k, w in enumerate(chain)], "word string, n long")
    got = {r["word"]: r for r in variants.grouped(words).collect()}
    assert {r["root"] for r in got.values()} == {"aaaaaaaa"}
    assert got["bbbbbbbb"]["form"] == "abbbbbbb" and got["aaaaaaaa"]["form"] is None and got["aabbbbbb"]["n_near"] == 2


def test_ties_go_to_the_smaller_word(spark):
    words = spark.createDataFrame([("abcdef", 1), ("abcdeg", 9), ("abcdee", 9)], "word string, n long")
    assert {r["word"]: r["form"] for r in variants.grouped(words).collect()}["abcdef"] == "abcdee"


# 12


def parts_by_force(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged_by_force(url: str | None, rules: tuple, listed: set[str] | None) -> tuple:
    host, path = parts_by_force(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = host in listed if listed is not None else bool(set(re.split(r"[.-]", host)) & set(url_filter.TERMS))
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://EXAMPLE.net/EN/x", "http://example.net/en/", "http://a.example.net/en/?q", "http://example.net/de/en/", "x://y.org/fr/#a", "http://org/fr/", "http://www.Example.com/de/1", "http://www.example.com?/de/",
    "http://www.example.com#://b.net/", "http://b.net://c/", "http://spam.example.com/en/", "http://x-ads.example.org", "http://xads.example.org/", "http://net./", "http://.net/", "http://a:80/", "http://u@b.net/p", "http://b.net\n/x", "http://ÄÖ.net/", "http://" + "a." * 3000 + "org/fr/" + "x/" * 3000,
]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    urls = [*URLS, *URLS[:9]]
    for _ in range(600):
        host = ".".join(rng.choice(["www", "a", "b-ads", "spam", "example", "news"]) for _ in range(rng.randint(0, 3))) + "." + rng.choice(["net", "org", "com", "example.net", "example.com"])
        urls.append(f"http://{host}/{rng.choice(['en', 'de', 'fr', ''])}/{rng.randint(0, 99)}")
    rows = [(k if k % 50 else None, u, "<p>") for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1)).withColumn("key", F.lit(1))


MANY = (*url_filter.RULES, ("allow", "a.example.net", "/en/1"), ("block", "www.a.org", "/"), ("allow", "spam.com", "/"))


@pytest.mark.parametrize("most_bits", [url_filter.MOST_BITS, 100])
@pytest.mark.parametrize("rules", [url_filter.RULES, MANY, url_filter.RULES[:1], ()])
def test_urls_equal_brute_force(pages, most_bits, rules):
    want = sorted(str((r["page_id"], *judged_by_force(r["url"], rules, None))) for r in pages.select("page_id", "url").collect())
    got = url_filter.judged(pages, rules, most_bits=most_bits)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want


@pytest.mark.parametrize("most_bits", [url_filter.MOST_BITS, 100])
def test_a_list_of_hosts(spark, pages, most_bits):
    hosts = {"a.net", "WWW.b-ads.com", "never.seen"}
    listed = spark.createDataFrame([*[(h, 1) for h in hosts], (None, 1), ("a.net", 2)], "host string, listed long")
    want = sorted(str((r["page_id"], *judged_by_force(r["url"], url_filter.RULES, {h.translate(FOLD) for h in hosts}))) for r in pages.select("page_id", "url").collect())
    assert sorted(str(tuple(r)) for r in url_filter.judged(pages, listed=listed, most_bits=most_bits).collect()) == want


@pytest.mark.parametrize("share", [0.001, 0.02, 0.5, 1.0])
def test_the_cascade_is_exact_over_its_universe(spark, share):
    """All keys, listed or not; the levels alternate until none has a false positive."""
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.pmod(F.hash("id"), F.lit(1000)) < share * 1000).alias("listed"))
    found = url_filter.cascade(keys)
    assert keys.where(found.contains(F.col("key")) != F.col("listed")).count() == 0
    assert len(found.levels) > 1 or share == 1.0


def test_one_level_does_not_do(spark):
    """The first level alone has false positives, so that the test above rests on the later ones."""
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 50 == 0).alias("listed"))
    found = url_filter.cascade(keys)
    assert keys.where(url_filter.Cascade(found.levels[:1], found.keys).contains(F.col("key")) & ~F.col("listed")).count() > 0


def test_urls_are_judged_in_the_scan(pages):
    """No join, no shuffle, no Python."""
    plan = url_filter.judged(pages)._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]
    assert not re.search("Join|Exchange|Python|Arrow", plan.split("Initial Plan")[-1])


def test_urls_of_nothing(pages):
    assert url_filter.judged(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="verdicts"):
        url_filter.judged(pages, (("block", "net", "/"), ("allow", "net", "/")))


# 13


def resampled_by_force(rows: list[tuple], target: list[str | None], percent: int, least: int, upto: int, buckets: int) -> list[tuple]:
    def features(text: str | None) -> list[int]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, upto + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for doc_id, text in rows:
        found, n_words = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    few = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(few[: percent * len(few) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in out)


@pytest.mark.parametrize(("percent", "least", "upto", "buckets"), [(10, 20, 1, 10_000), (100, 0, 1, 7), (50, 3, 3, 500), (0, 1, 2, 10_000)])
def test_resampling_equals_brute_force(spark, small, percent, least, upto, buckets):
    target = ["Abcde abc dee", None, "", "aaa bbb", " ".join(r["text"] for r in small.select("text").where("length(text) < 300").limit(3).collect())]
    want = resampled_by_force([tuple(r) for r in small.select("doc_id", "text").collect()], target, percent, least, upto, buckets)
    got = importance.resample(small, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").withColumn("n", F.lit(1)), percent, least, upto, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_resampling_of_nothing(spark, small, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(empty, none).count() == 0
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in importance.resample(small, none).collect()) == resampled_by_force(rows, [], 10, 20, 1, 10_000)


def test_ranks_go_on_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("score"), "id")
    got = importance.ranked(rows, F.col("score").desc(), F.col("id")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r["score"], r["id"]) for r in got] == sorted(((r["score"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))


def test_words_that_share_a_rare_beginning_do_not_all_meet(spark):
    """A bigram at a word's edge has nothing on one side: its words do not all meet, and none that are near are lost."""
    rng = random.Random(11)
    some = sorted({"zq" + "".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(400)})
    some += [w[:4] + "h" + w[5:] for w in some[:40]] + [w[:6] + w[7:] for w in some[40:80]] + [w[1:] for w in some[80:90]] + ["x" + w for w in some[90:100]]
    words = spark.createDataFrame([(k, w, 5) for k, w in enumerate(sorted(set(some)))], "id long, word string, n long")
    few = variants.rarest(words)
    keys = few.select(F.explode(variants.meetings(0)).alias("key")).groupBy("key").count()
    assert keys.agg(F.max("count")).first()[0] < 100
    pairs = words.alias("a").join(words.alias("b"), F.col("a.id") != F.col("b.id")).where(F.levenshtein("a.word", "b.word", 1) == 1)
    want = {frozenset(r) for r in pairs.select("a.word", "b.word").collect()}
    got = [frozenset(r) for r in variants.near_pairs(words).select("a_word", "b_word").collect()]
    assert len(want) >= 90 and len(got) == len(set(got)) and set(got) == want


def test_intermediate_tables_of_words_have_few_files(spark, monkeypatch):
    """Whatever the number of partitions is, tables of a row a word are few files, since each costs processes of the executor's size."""
    seen = []
    monkeypatch.setattr(variants, "written", lambda df, tag, files=None: seen.append((tag, files)) or common.written(df, tag, files))
    words = spark.createDataFrame([("abcdef", 100), ("abcdeg", 10), ("abcdeh", 1)], "word string, n long")
    assert variants.grouped(words).count() == 3
    assert [x for x in seen if x[0] != "vocabulary"] and all(n == 1 for tag, n in seen if tag != "vocabulary")
    assert not {tag for tag, _ in seen} & {"bigrams", "bigram-keys"}
