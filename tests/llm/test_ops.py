"""The corpus operators: brute force on small fixtures, edge cases, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescope.llm import common, license_scan, line_dedup, media, mixing, near_dedup, packing, ppm, quality, queries, repeats, topk
from tablescope.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = {i: i + 32 for i in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ab", "con", "de", "é", "fi", "gro", "Ha")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def small(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows and ids, and columns of clashing names."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 200)) for _ in range(40)]
    passage = prose(rng, 90)
    texts: list[str | None] = [*base, base[3], base[3] + " more", " ".join(base[5].split()[1:]), passage + base[7], base[8] + passage, f"{base[9]}\n{passage}\n{base[10]}", None, "", " \n\t ", "one", "a b c", prose(rng, 4000), "x" * 700, "ab" * 500]
    rows = [(k, t, "en", ("s1", "s2", None)[k % 3], 0 if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[3], None, None, 1), (7, "another text of the same id that is long enough to matter here", "en", "s1", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("row", F.lit("r")).withColumn("size", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def removed_by_force(texts: list[bytes], length: int) -> list[tuple]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "wide"), [(200, 128), (200, 1), (24, 128), (24, 3)])
def test_repeats_equal_brute_force(small, length, wide):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in small.select("doc_id", "text").collect()]
    want = sorted(str((i, *x)) for (i, _), x in zip(rows, removed_by_force([t for _, t in rows], length), strict=True))
    got = repeats.digests(small, length, min(length, 12) if length < 40 else None, wide).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_frequent_anchors_are_spread(spark, monkeypatch):
    """A passage that half of all texts hold, with a bound that makes its anchors frequent."""
    monkeypatch.setattr(repeats, "FEW", 40)
    rng = random.Random(12)
    passage = prose(rng, 60)
    texts = [prose(rng, 40) + (passage if k % 2 else "") + prose(rng, 5) for k in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = repeats.occurrences(repeats.with_rows(rows), 200, 40).groupBy("anchor").agg(F.count("*").alias("n"))
    total = keys.agg(F.sum("n")).first()[0]
    assert keys.where(F.col("n") > total // 40).count() > 0
    want = sorted(str((k, *x)) for k, x in enumerate(removed_by_force([x.encode() for x in texts], 200)))
    assert sorted(str(tuple(r)) for r in repeats.digests(rows).collect()) == want


def test_repeats_of_nothing(empty):
    assert repeats.digests(empty).count() == 0


def test_maximal_repeats_list_all_occurrences():
    contexts = [b"..HELLO WORLD one", b"##HELLO WORLD two", b"!!HELLO WORLD one"]
    array = repeats.SuffixArray(contexts, np.ones(3, np.int64), 8)
    found = defaultdict(set)
    for size, places in array.repeats():
        found[bytes(array.data[places[0] : places[0] + size])] |= {int(p) for p in places}
    assert found[b"HELLO WORLD "] == {2, 19, 36} and found[b"HELLO WORLD one"] == {2, 36}


def groups_by_force(texts: list[bytes], length: int) -> set:
    """(string, places) of all strings that several places share and that differ before and after them."""
    places = defaultdict(set)
    for d, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + length, len(t) + 1):
                places[t[a:b]].add((d, a))
    out = set()
    for s, some in places.items():
        left = {texts[d][a - 1] if a else (d, a) for d, a in some}
        right = {texts[d][a + len(s)] if a + len(s) < len(texts[d]) else (d, a) for d, a in some}
        if len(some) > 1 and len(left) > 1 and len(right) > 1:
            out.add((s, frozenset(some)))
    return out


@pytest.mark.parametrize("wide", [128, 2, 1])
def test_groups_equal_brute_force(spark, wide):
    """Passages in passages, copies, periodic texts and hot anchors; all maximal repeats, at full length, with all occurrences."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    a, c = word(40), word(30)
    texts = [word(9) + a + word(7), word(5) + a + c + word(4), a + c, a + c, word(6) + a[5:] + word(8), "abababababababababab", "x" * 24, word(12), "", word(20) + c + word(3) + c]
    texts += [a[:25] + word(6) for _ in range(6)] + [word(6) + a + c]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = repeats.with_rows(rows)
    name = {(r["doc"], r["row"]): r["doc"] for r in docs.collect()}
    found = defaultdict(set)
    for r in repeats.Repeats(docs, 12, 6, wide).groups().collect():
        found[r["repeat"], r["length"]].add((name[r["doc"], r["row"]], r["start"]))
    got = set()
    for (_, n), some in found.items():
        d, at = min(some)
        got.add((texts[d][at : at + n].encode(), frozenset(some)))
    assert got == groups_by_force([x.encode() for x in texts], 12)


@pytest.mark.parametrize("wide", [128, 1])
def test_summaries_equal_brute_force(spark, wide):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    a, c = word(40), word(30)
    texts = [word(9) + a + word(7), word(5) + a + c + word(4), a + c, a + c, word(6) + a[5:] + word(8), "ab" * 30, "ab" * 30, "x" * 24, word(12), "", word(20) + c + word(3) + c, c + "é" + a]
    texts += [a[:25] + word(6) for _ in range(6)] + [word(6) + a + c]
    docs = repeats.with_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = sorted((len(s), len(some), *min(some), *max(some), sum((d * 31 + at) % 1000003 for d, at in some)) for s, some in groups_by_force([x.encode() for x in texts], 12))
    assert sorted(map(tuple, repeats.Repeats(docs, 12, 6, wide).summary().collect())) == want


def test_a_run_is_sent_once_to_a_part(spark):
    """A periodic run has starts in its whole length: its bytes with each of them would be the square of it."""
    n = 6000
    starts = [{"at": at, "window": at % 7, "before": 97} for at in range(n)]
    members = spark.createDataFrame([(0, 1, b"abcdefg" * (n // 7 + 60), starts)], "entry long, n long, bytes binary, starts array<struct<at: long, window: long, before: int>>")
    rows = repeats.dealt(members).collect()
    assert sorted(s["at"] for r in rows for s in r["starts"]) == list(range(n)) and sum(len(r["bytes"]) for r in rows) <= 7 * (n + 500)
    assert all(r["from"] == min(s["at"] for s in r["starts"]) for r in rows)


def test_suffixes_are_sorted_by_pieces():
    data = b"ababab" * 400 + b"b"
    start = [0, 2, 4, 5, 4, 2400 - 3, 1]
    order = repeats.suffix_order(data, start, [len(data)] * 6 + [700], 16)
    assert [data[start[k] : 700 if k == 6 else None] for k in order] == sorted(data[start[k] : 700 if k == 6 else None] for k in range(7))


def test_intervals_of_a_tree():
    # aXbc, aXbd, cXbc: sorted suffixes Xbc, Xbc, Xbd
    assert sorted(repeats.intervals(np.asarray([0, 3, 2]), np.asarray([97, 99, 97]), 2)) == [(2, 0, 2), (3, 0, 1)]
    assert repeats.intervals(np.asarray([0, 3]), np.asarray([97, 97]), 2) == []


# 2


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(k), rng.normal(0, 0.15, 16).astype(float).tolist()) for k in range(420)]
    vectors += [(500, None), (600, [1.0, None] + [0.0] * 14), (700, [float("nan")] * 16), (800, [float("inf")] * 16), (900, vectors[0][1]), (901, vectors[0][1]), (None, vectors[1][1]), (1000, [0.0] * 16)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = defaultdict(list)
    for r in topk.search(rows, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {k: np.floor(1024 * np.asarray(v)).astype(int) for k, v in vectors if k is not None and v is not None and None not in v and np.isfinite(v).all()}
    for q in (k for k in fine if k % 100 == 0):
        assert got[q] == [(k, s) for s, k in sorted(((int(fine[q] @ v), k) for k, v in fine.items() if k != q), key=lambda x: (-x[0], x[1]))[:10]]
    assert set(got) == {k for k in fine if k % 100 == 0}
    assert topk.search(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.search(rows.where("vec_id IN (0, 1)"), F.col("vec_id") % 100 == 0).count() == 1


def test_rows_of_one_id_are_all_candidates(spark):
    rows = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (200, [0.0, 1.0]), (200, [0.0, 1.0]), (7, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(rows, F.col("vec_id") % 100 == 0, 2).collect())
    one = 1024 * 1024
    assert got == sorted([(100, 1, 1, 921 * 1024), (100, 2, 1, 512 * 1024), (200, 1, 200, one), (200, 1, 200, one), (200, 2, 1, 0), (200, 2, 1, 0)])


def test_search_in_a_grid_of_cells(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("HIGH", 2), ("ACROSS", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.3, (300, 4))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    fine = np.floor(vectors * 1024).astype(int)
    want = [(q, n, k, -s) for q in range(0, 300, 100) for n, (s, k) in enumerate(sorted((-int(fine[q] @ fine[k]), k) for k in range(300) if k != q)[:10], 1)]
    assert sorted(tuple(r) for r in topk.search(rows, F.col("vec_id") % 100 == 0).collect()) == want


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 5, (3000, 16)).astype(np.int64)
    vectors[::100] += rng.integers(200, 900, 16)
    index = topk.Index(np.arange(3000), vectors)
    query = np.abs(rng.normal(0, 300, 16)).astype(np.int64)
    ids, scores = index.search(query, 5)
    exact = vectors @ query
    assert ids.tolist() == np.lexsort((np.arange(3000), -exact))[:5].tolist() and scores.tolist() == exact[ids].tolist()


# 3


def bags_of(texts: list[str | None]) -> list[Counter]:
    out = []
    for t in texts:
        w = words_of(t)
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    return out


def classes_by_force(texts: list[str | None]) -> list[int]:
    bags, up = bags_of(texts), list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            both = sum((a & b).values())
            if (not a and not b) or (a and b and both / (sum(a.values()) + sum(b.values()) - both) >= 0.8):
                up[root(i)] = root(j)
    return [root(k) for k in range(len(texts))]


def test_near_duplicates_equal_brute_force(small):
    rows = small.where("doc_id IS NOT NULL AND NOT (doc_id = 7 AND n_chars = 1)").distinct().select("doc_id", "text").collect()
    roots = classes_by_force([r["text"] for r in rows])
    least = defaultdict(lambda: 1 << 60)
    for r, k in zip(rows, roots, strict=True):
        least[k] = min(least[k], r["doc_id"])
    want = {r["doc_id"]: least[k] for r, k in zip(rows, roots, strict=True)}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(small.where("NOT (doc_id = 7 AND n_chars = 1)")).collect() if r["doc_id"] is not None}
    assert got == want


def test_large_groups_stay_whole(spark):
    rng = random.Random(2)
    base = prose(rng, 120).split()
    texts = [" ".join(base[:k % 120] + [f"w{k}"] + base[k % 120 + 1 :]) for k in range(700)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {(r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(rows).collect()} == {(0, 700)}


def test_bridges_keep_a_class_of_hundreds_whole(spark):
    """At the shipped parameters: 700 variants of one text, and 35 texts that resemble one or a few of them only."""
    rng = random.Random(5)
    base = [f"b{rng.random()}" for _ in range(120)]
    texts = []
    for k in range(700):
        at = 20 + k % 80
        texts.append([*base[:at], f"v{k}", *base[at + 1 :]])
    for k in range(35):
        some = list(texts[k * 20])
        some[5], some[112] = f"x{k}", f"y{k}"
        texts.append(some)
    texts = [" ".join(t) for t in texts]
    roots, least = classes_by_force(texts), {}
    for k, r in enumerate(roots):
        least.setdefault(r, k)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {k: least[r] for k, r in enumerate(roots)}


@pytest.mark.parametrize(("group", "members"), [(4, 1), (16, 2), (256, 8)])
def test_chains_keep_all_links(spark, monkeypatch, group, members):
    """Texts that only their neighbours in a chain resemble, in groups that are cut into parts at the smaller two settings."""
    monkeypatch.setattr(near_dedup, "GROUP", group)
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    rng, texts = random.Random(3), []
    for _ in range(3):
        words = [f"w{rng.random()}" for _ in range(120)]
        for k in range(20):
            texts.append(" ".join(words))
            words = [f"w{rng.random()}" if 0 <= j - k * 13 % 110 < 5 else w for j, w in enumerate(words)]
    rng.shuffle(texts)
    roots, least = classes_by_force(texts), {}
    for k, r in enumerate(roots):
        least.setdefault(r, k)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {k: least[r] for k, r in enumerate(roots)}


@pytest.mark.parametrize(("group", "members"), [(4, 1), (16, 2)])
def test_split_groups_are_exact(spark, monkeypatch, group, members):
    """Chains, and letters about 0.75 alike, whose links only members that the first rounds leave behind have."""
    monkeypatch.setattr(near_dedup, "GROUP", group)
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    rng, texts = random.Random(3), []
    for _ in range(3):
        words = [f"w{rng.random()}" for _ in range(120)]
        for k in range(25):
            texts.append(" ".join(words))
            words = [f"w{rng.random()}" if 0 <= j - k * 13 % 110 < 5 else w for j, w in enumerate(words)]
    form = [f"f{rng.random()}" for _ in range(120)]
    for _ in range(30):
        at = rng.randint(0, 100)
        letter = [f"w{rng.random()}" if at <= j < at + 5 else w for j, w in enumerate(form)]
        texts += [" ".join(letter), " ".join([*letter[:-1], "end"])]
    rng.shuffle(texts)
    roots, least = classes_by_force(texts), {}
    for k, r in enumerate(roots):
        least.setdefault(r, k)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {k: least[r] for k, r in enumerate(roots)}


def test_keep_one(small, empty):
    some = small.where("NOT (doc_id = 7 AND n_chars = 1)")  # whose class has the same name as that of the other row of its id
    kept = near_dedup.keep_one(some)
    assert kept.columns == small.columns and kept.count() == near_dedup.near_duplicates(some).select("class_id").distinct().count()
    assert near_dedup.keep_one(empty).count() == 0 == near_dedup.near_duplicates(empty).count()


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    pairs, agree, true = 150, 0.0, 0.0
    for _ in range(pairs):
        items = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
        true += np.minimum(a, b).sum() / np.maximum(a, b).sum()
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        got = near_dedup.signatures(2, doc, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]))
        agree += (got[0] == got[1]).mean()
    assert abs(agree - true) / pairs < 0.012


# 4


def test_word_scores_equal_brute_force(small):
    rows = small.select("doc_id", "text").collect()
    tokens = [[*words_of(r["text"]), None] for r in rows]
    learned = [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 != 2 for r in rows]
    c = Counter(w for t, ok in zip(tokens, learned, strict=True) if ok for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(t), sum(c[w] > 0 for w in t), n, not ok, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for r, t, ok in zip(rows, tokens, learned, strict=True))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], r["base_score"]) for r in ppm.score(small).collect())
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-9)


def test_ppm_sums_hold_each_key_a_few_times():
    """Pieces of a chunk share most of their symbols in context: what is held follows the different ones, not the pieces."""
    import tracemalloc

    keys, ones = np.arange(50_000, dtype=np.int64), np.ones(50_000, np.int64)
    tracemalloc.start()
    found = ppm.Sums()
    for _ in range(64):
        found.add(keys.copy(), ones.copy())
    got, many = found.all()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == keys).all() and (many == 64).all()
    assert most < 16 * (keys.nbytes + ones.nbytes)  # all at once: over 64 times
    parts = [ppm.sums_of(np.random.default_rng(k).integers(0, 99, 60), np.arange(60)) for k in range(7)]
    for some in (parts[:k] for k in range(8)):
        found = ppm.Sums()
        for p in some:
            found.add(*p)
        got, (want, sums, _) = found.all(), ppm.totals([k for k, _ in some], [n for _, n in some])
        assert got[0].tolist() == want.tolist() and got[1].tolist() == sums.tolist()


def ppm_by_definition(learned: list[bytes], text: bytes) -> float:
    """log10 probability of a text, from counting in all training texts anew for each symbol and order."""
    held = [b"\0" * 5 + t for t in learned]
    total, mine = 0.0, b"\0" * 5 + text
    for at in range(5, len(mine) + 1):
        s, out, reach = (mine[at] if at < len(mine) else 256), set(), 1.0
        for k in (5, 4, 3, 2, 1, 0):
            seen = Counter()
            for t in held:
                for i in range(5, len(t) + 1):
                    if t[i - k : i] == mine[at - k : at]:
                        seen[t[i] if i < len(t) else 256] += 1
            seen = Counter({x: n for x, n in seen.items() if x not in out})
            left = 257 - len(out) > len(seen)  # no escape where nothing is left to escape to
            if s in seen:
                reach *= seen[s] / (sum(seen.values()) + len(seen) * left)
                break
            if seen:
                reach *= len(seen) / (sum(seen.values()) + len(seen))
            out |= set(seen)
        else:
            reach /= 257 - len(out)
        total += math.log10(reach)
    return total


@pytest.mark.parametrize("limit", [1 << 21, 16])
def test_model_equals_its_definition(spark, limit):
    """All contexts of all orders, also with texts cut into pieces of a few bytes."""
    rng = random.Random(6)
    docs = [(k, " ".join("".join(rng.choice("abré\x00") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 9)))) for k in range(30)]
    docs += [(30, None), (31, "zq"), (31, "zq"), (None, "abra"), (32, "one-word-of-more-than-sixteen-bytes and others")]
    learned = [(t or "").encode() for k, t in docs if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2]
    want = sorted((-1 if k is None else k, ppm_by_definition(learned, (t or "").encode())) for k, t in docs)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in ppm.score(rows, limit).collect())
    assert [k for k, _ in got] == [k for k, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], atol=1e-4)


def test_pieces_change_no_score(small):
    def key(r):
        return (-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3), round(r["score"], 1))

    assert sorted(map(key, ppm.score(small, 300).collect())) == sorted(map(key, ppm.score(small).collect()))


def test_adaptive_model_learns():
    assert ppm.adaptive(b"abc" * 50) > 5 * ppm.adaptive(b"abc" * 5)
    assert abs(ppm.adaptive(b"") - math.log10(1 / 257)) < 1e-12


def test_scores_without_training_texts(spark, empty):
    assert ppm.score(empty).count() == 0
    only = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = ppm.score(spark.createDataFrame([(only, "ab", None, None, 2)], DOCS)).first()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and abs(row["score"] - 3 * math.log10(1 / 257)) < 1e-4


# 5


def test_quality_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = quality.scored(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert got.count() > 50 and right > 0.95


def test_updates_and_scores_equal_a_plain_loop():
    """Follow the regularised leader, a coordinate at a time, and the sparse dot product, a feature at a time."""
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 30)).encode() for _ in range(40)]
    labels = [rng.randint(0, 1) for _ in texts]
    rows = quality.sparse(texts)
    z, n = defaultdict(float), defaultdict(float)
    share = {c: 0.5 * len(labels) / labels.count(c) for c in (0, 1)}

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for epoch in range(quality.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            pairs = list(zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True))
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - labels[k]) * share[labels[k]] * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = quality.fit(rows, labels)
    assert np.allclose([got[i] for i in sorted(z)], [weight(i) for i in sorted(z)], atol=1e-4) and np.count_nonzero(got) <= len(z)
    scores = quality.scorer(got)(texts)
    for score, (places, values) in zip(scores, rows, strict=True):
        assert abs(score - 1 / (1 + math.exp(-sum(float(got[i]) * v for i, v in zip(places.tolist(), values.tolist(), strict=True))))) < 1e-5


def test_repeated_ids_are_learned_once(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other words"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4, 5, 6)], "doc_id long, quality int")
    assert (quality.train(docs, labels) == quality.train(docs.repartition(5), labels)).all()


CLASHING = ("__score", "__predicted", "__text", "__copies", "__copy", "__row", "__starts", "row", "doc", "score", "size", "copies", "starts", "part", "id", "all", "n", "k")


def test_stages_take_columns_of_any_name(spark, small):
    some = small.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    for out in (quality.keep_good(some, labels), line_dedup.dedup_lines(some), near_dedup.keep_one(some), mixing.mixed(some)):
        assert out.columns == some.columns
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)


def test_scoring_holds_little_beside_the_texts():
    rng = random.Random(5)
    batch = pa.RecordBatch.from_arrays([pa.array([prose(rng, 300) for _ in range(2000)])], names=["text"])
    score = quality.scorer(np.zeros((1 << quality.BITS) + 1, np.float32))
    tracemalloc.start()
    for part in common.chunked([batch]):
        score(common.encoded(part.column("text")))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 3 << 20 and most < 60 << 20, (batch.nbytes, most)


def test_quality_edges(spark, small, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(small, labels).collect()
    assert len(got) == small.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in quality.scored(small, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(empty, labels).count() == 0
    assert quality.keep_good(small, labels).columns == small.columns


# 6


def test_licences_equal_brute_force(spark, small):
    notes = ["Licensed under CC BY-NC 4.0.", "x CC BY CC  by cc-by", "MIT License. mit license", "This work is licensed under the GNU General Public License, version 3.", "gnu general public", "ALL Rights\nreserved", "licensed under the Apache License, Version 2.0 and more words"]
    notes += [
        " * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated\n * documentation files (the Software)",
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following\n# conditions are met:",
        "This Source Code Form is subject to the terms of\nthe Mozilla Public License, v. 2.0. If a copy",
        "all of the many rights that anyone ever reserved", "reserved all rights", "rights", " ".join(["all"] * 3000 + ["rights", "reserved"]),
    ]
    rows = small.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(notes)], "doc_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for r in rows.collect():
        folded = (r["text"] or "").translate(FOLD)
        w = word.findall(folded)
        places = [(k, lab) for p, lab in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        found = []
        for t, lab in license_scan.TEMPLATES:
            size, own = license_scan.wide(t), set(t.split())
            found += [(len(own & set(w[k : k + size])) / len(own), lab) for k in range(max(1, len(w) - size + 1)) if len(own & set(w[k : k + size])) >= license_scan.need(t)]
        base = {lab for _, lab in places}
        want.append(str((r["doc_id"], len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for _, x in found})), 1.0 if places else max((c for c, _ in found), default=0.0))))
    got = license_scan.scan(rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)
    wrapped = {r["doc_id"]: r["labels"] for r in got.where("doc_id BETWEEN 107 AND 109").collect()}
    assert wrapped == {107: "mit", 108: "bsd", 109: "mpl"}
    assert license_scan.scan(rows.limit(0)).count() == 0


# 7


def test_mix_meets_targets_and_agrees_again(small, empty):
    got = mixing.mix(small)
    rows = got.collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(small.repartition(7)).collect()))
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert sum(r["size"] for r in v) == v[0]["source_size"] and v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)
        assert all(r["taken"] <= 2 * r["size"] for r in v)
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()
    out = mixing.mixed(small)
    assert out.columns == small.columns
    assert sum(len(words_of(r["text"])) for r in out.collect()) == sum(r["taken"] for r in rows)


def test_parts_stay_even_and_repeated_rows_are_shared_out(spark):
    rows = spark.createDataFrame([(k, f"{k} 12345", "s") for k in range(4000)] + [(-1, "seven words of a row there often", "s")] * 3000 + [(-2, None, None)] * 50, "doc_id long, text string, source string")
    got = mixing.mix(rows, (1,), 0.6, 2)
    by = {r["doc_id"]: (r["n"], r["taken"]) for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()}
    assert by[-1][0] == 3000 and by[-2] == (50, 0) and len(by) == 4002
    total = 4000 * 2 + 3000 * 7
    assert abs(sum(t for _, t in by.values()) - 0.6 * total) <= 7
    keys = mixing.sized(rows.where("doc_id >= 0")).groupBy(F.floor(F.log("sort_key") * 64)).count().agg(F.max("count")).first()[0]
    assert keys < 2 * 4000 / 64


def test_heavier_documents_come_first(spark):
    rows = spark.createDataFrame([(k, "w " * 10, "s", 1.0 if k % 2 else 9.0) for k in range(2000)], "doc_id long, text string, source string, w double")
    got = mixing.mix(rows, (1,), 0.3, 2, F.col("w")).where("copies = 1").select((F.col("doc_id") % 2).alias("odd")).groupBy("odd").count().collect()
    n = {r["odd"]: r["count"] for r in got}
    assert n[0] > 3 * n[1]


# 8


def test_pieces_and_places(spark, small, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["  a", "a  b", "a   b\n\n c", "\n", "a\n b\t\tc", "don't we'll\n'tis 12 345", "x\ty z\r\nq", " lead", "trail ", "nul\0l", "<|endo", "a <|endoftext|> b", "中文 字 \U0001f600", "a b"]
    rows = small.select("doc_id", "text").unionByName(spark.createDataFrame([(200 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    want = Counter()
    for r in rows.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        at = first = len(ids) % 1024 or 1024
        cuts = [(0, first)] + [(x, 1024) for x in range(at, len(ids), 1024)]
        want.update(str((r["doc_id"], k, a, n, zlib.crc32(np.asarray(ids[a : a + n], "<u4").tobytes()))) for k, (a, n) in enumerate(cuts))
    got = packing.pack(rows).collect()
    assert Counter(str(tuple(r)[:5]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in bins.values():
        some.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(some, some[1:], strict=False)) and some[0][0] == 0 and sum(some[-1]) <= 1024
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize(("low", "high", "n", "waste"), [(1, 1024, 20000, 1.01), (300, 700, 20000, 1.02), (1, 60, 3000, 1.01), (900, 1024, 500, 1.2), (500, 520, 3, 2)])
def test_packs_are_whole_and_tight(low, high, n, waste):
    lengths = np.random.default_rng(n).integers(low, high + 1, n)
    size, count = np.unique(lengths, return_counts=True)
    packer = packing.Packer(dict(zip(size.tolist(), count.tolist(), strict=True)))
    seen = defaultdict(list)
    for length, rank, bins, _, _ in packer.table():
        seen[length].append((rank, bins))
    for s, c in zip(size.tolist(), count.tolist(), strict=True):
        at = 0
        for rank, bins in sorted(seen[s]):
            assert rank == at
            at += bins
        assert at == c
    assert sum(r[0] for r in packer.runs) <= max(-(-int(lengths.sum()) // 1024) * waste, n if low > 512 else 0)


# 9


def test_line_chunks(spark, small, empty):
    rng = random.Random(9)
    lines = [prose(rng, 9) for _ in range(60)]
    shared = "\n".join(lines[10:30])
    docs = [(0, "\n".join(lines[:10]) + "\n" + shared), (1, prose(rng, 5) + "\n" + shared + "\n" + prose(rng, 7)), (2, shared), (3, None), (4, ""), (5, lines[0]), (2, shared)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text")).withColumn("__x", F.lit(1))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(rows).collect()}
    assert got[0]["text"] == docs[0][1] and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == lines[0]
    assert len(got[1]["text"]) < 0.5 * len(docs[1][1]) and len(got[2]["text"]) < 0.5 * len(shared) and got[2]["n_chars"] == len(got[2]["text"])
    assert line_dedup.dedup_lines(small).columns == small.columns and line_dedup.dedup_lines(empty).count() == 0


def cuts_by_definition(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, lines): whole-number arithmetic, a line at a time."""
    m = (1 << 64) - 1

    def mixed(h: int) -> int:
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & m
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & m
        return h ^ (h >> 31)

    base, out, first, at, before, n = 0x9E3779B97F4A7C15, [], 0, 0, 0, 0
    lines = data.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    for k, line in enumerate(lines):
        name, power = 0, 1
        body = line[:-1] if line.endswith(b"\n") else line
        for c in body:
            name, power = (name + mixed((c + 1) * 0xD6E8FEB86659FD93 & m) * power) & m, power * base & m
        name = mixed((name + len(body) * 0xBF58476D1CE4E5B9) & m) if body else 0
        at, n = at + len(line), n + 1
        stop = mixed((name + before * 0x9E3779B97F4A7C15) & m) & 1 == 0
        before = name
        if k + 1 == len(lines) or n >= 16 or (n >= 2 and stop):
            out.append((first, at, n))
            first, n = at, 0
    return out


def test_chunks_of_many_texts_are_cut_at_once(monkeypatch):
    rng = random.Random(12)
    rows = [b"", *("\n".join(prose(rng, rng.randint(0, 3)) for _ in range(rng.randint(0, 40))).encode() + b"\n" * rng.randint(0, 2) for _ in range(60)), b"", b"\n", b"a"]
    calls = []
    monkeypatch.setattr(line_dedup, "run_hashes", lambda *a, f=line_dedup.run_hashes: calls.append(1) or f(*a))
    of, start, end, lines, _ = line_dedup.cut_all(rows)
    assert calls == [1]
    assert list(zip(of.tolist(), start.tolist(), end.tolist(), lines.tolist())) == [(k, *x) for k, row in enumerate(rows) for x in cuts_by_definition(row)]
    assert [len(x) for x in line_dedup.cut_all([])] == [0] * 5


def test_line_chunks_equal_brute_force(small):
    rows = sorted({(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").where("doc_id IS NOT NULL AND NOT (doc_id = 7 AND n_chars = 1)").collect() if r["text"] is not None})
    seen: dict[bytes, tuple] = {}
    want = {}
    for doc_id, text in rows:
        data, kept = text.encode(), []
        for a, b, n in cuts_by_definition(data):
            body = data[a:b].rstrip(b"\n")
            if n >= 2 and seen.setdefault(body, (doc_id, a)) != (doc_id, a):
                continue
            kept.append(data[a:b])
        want[doc_id] = b"".join(kept).decode()
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(small.where("doc_id IS NOT NULL AND NOT (doc_id = 7 AND n_chars = 1)").distinct()).collect() if r["text"] is not None}
    assert got == want


def test_repeated_chunks_of_short_lines_go(spark):
    rng = random.Random(4)
    passage = "\n".join(" ".join(f"{rng.randint(10000, 99999)}" for _ in range(4)) for _ in range(20))
    alone = [f"only here {k}" for k in range(3)]
    docs = [(0, passage), (1, passage), (2, "\n".join([alone[0], passage, alone[1]])), (3, alone[2])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == passage and got[3] == alone[2]
    assert len(got[1].splitlines()) <= 1  # a chunk of a single line is none of several
    assert alone[0] in got[2] and alone[1] in got[2] and len(got[2]) < 0.5 * len(passage)


def test_boundaries_survive_shifts():
    rng = random.Random(1)
    lines = [prose(rng, 6) for _ in range(200)]
    data = "\n".join(lines).encode()
    moved = ("new first line\n" + "\n".join(lines[:90] + ["inserted"] + lines[90:])).encode()
    pieces = lambda d: {d[a:b].rstrip(b"\n") for a, b, *_ in line_dedup.cuts(d)}
    assert len(pieces(data) & pieces(moved)) >= 0.9 * len(pieces(data)) - 3
    assert b"".join(data[a:b] for a, b, *_ in line_dedup.cuts(data)) == data


# 10


@pytest.mark.parametrize("units", [1, 2, 31, 8191, 8192])
def test_media_round_trip(units, monkeypatch):
    payload = np.random.default_rng(units).integers(0, 256, units * 192, dtype=np.uint8).tobytes()
    written = media.encode_payload(payload)
    fast = media.coefficients(written)
    assert media.stored(fast) == payload
    if units < 40:  # the same, one symbol after another
        monkeypatch.setattr(media, "_even", lambda *a: False)
        slow = media.coefficients(written)
        assert media.stored(slow) == payload and (media.rgb(slow) == media.rgb(fast)).all()


def test_media_digests(small, empty):
    for r in media.digests(small).collect():
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= max(192, r["n_bytes"])
    for row, got in zip(small.select("doc_id", "text").collect(), media.digests(small).collect(), strict=True):
        data = (row["text"] or "").encode()
        data += b" " * (192 if not data else -len(data) % 192)
        assert (got["payload_sha256"], got["tail_crc32"]) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert media.digests(empty).count() == 0
    first = media.media_columns(small.limit(1)).first()
    assert len(first["rgb"]) == 3 * first["height"] * first["width"]


def bits_of(values) -> bytes:
    return media.padded(np.asarray([int(c) for v in values for c in v], np.uint8))


def test_long_texts_are_several_files(monkeypatch):
    text = b"".join(bytes([k % 256]) * 7 for k in range(900))
    whole = media.digest(text)
    monkeypatch.setattr(media, "PART", 192 * 5)
    parts = list(media.encoded_parts(media.payload_of(text)))
    assert len(parts) == -(-len(media.payload_of(text)) // 960) and b"".join(media.stored(media.coefficients(p)) for p in parts) == media.payload_of(text)
    cut = media.digest(text)
    assert cut[:4] == whole[:4] and cut[4] == sum(map(len, parts)) and cut[5] == hashlib.sha256(b"".join(parts)).hexdigest()


def test_media_reads_general_scans():
    """A file with subsampled chroma, runs of zeros and refinement of new coefficients, written by hand."""
    out = [b"\xff\xd8", media.segment(0xDB, bytes((0, *[2] * 64))), media.segment(0xC2, bytes((8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0)))]
    out.append(media.segment(0xC4, bytes((0x00, 1, 1, *[0] * 14, 0, 3))))  # 0: no change; 10: three bits
    out.append(media.scan([1, 2, 3], 0, 0, 0, 1, bits_of(["10", "101", "0", "0", "0", "0", "0"])))
    out.append(media.scan([1, 2, 3], 0, 0, 1, 0, bits_of(["1", "0", "0", "0", "0", "1"])))
    out.append(media.segment(0xC4, bytes((0x10, 0, 3, *[0] * 14, 0x00, 0x21, 0x10))))  # 00: end; 01: two zeros, then one bit; 10: a run of ends
    out.append(media.scan([1], 1, 63, 0, 1, bits_of(["01", "1", "00", "10", "1"])))
    out.append(media.scan([1], 1, 63, 1, 0, bits_of(["01", "0", "1", "00", "00", "00", "00"])))
    image = media.coefficients(b"".join([*out, b"\xff\xd9"]))
    y = image.parts[1]["coef"].reshape(-1, 64)
    assert y[:, 0].tolist() == [11, 10, 10, 10] and image.parts[3]["coef"][0, 0, 0] == 1 and image.parts[2]["coef"][0, 0, 0] == 0
    assert (y[0, 3], y[0, 4]) == (3, -1) and y[0, 1:].astype(bool).sum() == 2 and not y[1:, 1:].any()
    assert media.rgb(image).shape == (16, 16, 3)


def test_transform_equals_its_definition():
    rng = np.random.default_rng(4)
    block = np.zeros((8, 8))
    block.ravel()[media.zigzag()] = coef = rng.integers(-60, 60, 64)
    x = np.arange(8)
    scale = np.where(x == 0, np.sqrt(0.5), 1.0)
    want = np.zeros((8, 8))
    for r in range(8):
        for c in range(8):
            want[r, c] = sum(scale[u] * scale[v] / 4 * block[u, v] * np.cos((2 * r + 1) * u * np.pi / 16) * np.cos((2 * c + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
    assert np.abs((coef.astype(float) @ media.transform()).reshape(8, 8) / 4096 - want).max() < 0.5
    with pytest.raises(ValueError):
        media.coefficients(b"no image")


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES if q.startswith("op")}
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_near_copies_are_candidates_by_few_edges(spark, monkeypatch):
    """A group of near copies is held together by its hubs: far fewer edges than its texts have buckets."""
    edges = {}
    whole = near_dedup.components

    def counted(links, tag):
        edges[tag] = links.where("a <> b").distinct().count()
        return whole(links, tag)

    monkeypatch.setattr(near_dedup, "components", counted)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(rows).collect()} == {(0, 120)}
    assert edges["candidates"] < len(texts)
