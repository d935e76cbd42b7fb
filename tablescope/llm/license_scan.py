"""Licence scans: an exact set-similarity join of text blocks with notice templates, in built-in expressions alone.

A template's blocks are all runs of `wide` consecutive words of a text, a quarter more than the template's own words, so
that a notice is found however its lines are wrapped, marked as comments or cut into sentences. A block carries the
template's label if it holds at least THRESHOLD of the template's different words. Words are put in one global order, the
rarest first, by the number of texts of the whole corpus that hold them. A pair that meets the threshold shares one of the
first |T| - need + 1 words of the template (prefix filter), so that only blocks around such a word are looked at; the text
has at least `need` of the template's words (length filter); and so have the words around the shared one, where of those
before it in the order at most its place can be shared (positional filter). What the filters leave is verified by the overlap
itself, so the result is that of comparing all pairs.

Texts are read once. The templates are a fixed table, so what is broadcast has a bound that does not depend on the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts, written

THRESHOLD = 0.8
#: Phrase, label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices and the labels that they give.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("all rights reserved", "all-rights-reserved"),
)
#: All ASCII but digits and letters; upper case has been folded.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a folded text, with one blank before, between and after them; a single blank if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), GAP, " ")


def count_words(padded: Column) -> Column:
    """Words of a text of the form ' a b': each has a blank before it."""
    return (F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))).cast("long")


def vocabulary() -> list[str]:
    return sorted({w for t, _ in TEMPLATES for w in t.split()})


def need(template: str) -> int:
    return math.ceil(THRESHOLD * len(set(template.split())) - 1e-9)


def wide(template: str) -> int:
    """Words of a block of this template."""
    return math.ceil(len(template.split()) / THRESHOLD - 1e-9)


def literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def frequencies(kept: DataFrame) -> dict[str, int]:
    """Texts that hold each word of the vocabulary, over all texts: a row for each word at most comes to the driver."""
    found = kept.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in found}


def index(spark: SparkSession, ordered: list[str]) -> DataFrame:
    """A row for each word of each template's prefix: word, its place, template's words in the global order, least overlap, size, words of a block and label."""
    place, rows = {w: k for k, w in enumerate(ordered)}, []
    for template, label in TEMPLATES:
        words = sorted(set(template.split()), key=place.__getitem__)
        for at, w in enumerate(words[: len(words) - need(template) + 1]):
            fields = {"word": w, "at": at, "need": need(template), "of": len(words), "wide": wide(template), "label": label}
            rows.append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], literal(words).alias("template")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def found_blocks(kept: DataFrame) -> DataFrame:
    """key, label and the highest containment around each word of a template's prefix that meets the threshold, of kept (key, held, words); a pair may come more than once."""
    seen = frequencies(kept)
    ordered = sorted(vocabulary(), key=lambda w: (seen.get(w, 0), w))
    join = F.broadcast(index(kept.sparkSession, ordered))
    place, widest = {w: k for k, w in enumerate(ordered)}, max(wide(t) for t, _ in TEMPLATES)
    prefixes = sorted({w for t, _ in TEMPLATES for w in sorted(set(t.split()), key=place.__getitem__)[: len(set(t.split())) - need(t) + 1]})
    there = F.filter(F.transform("words", lambda x, i: F.struct(i.alias("i"), x.alias("word"))), lambda s: F.array_contains(literal(prefixes), s["word"]))

    def around(s: Column) -> Column:
        first = F.greatest(s["i"] - (widest - 1), F.lit(0))
        return F.struct(s["word"].alias("word"), (s["i"] - first).alias("i"), F.slice("words", first + 1, s["i"] - first + widest).alias("near"))

    at = kept.where("words IS NOT NULL").select("key", F.inline(F.transform(there, around)))
    pairs = at.join(join, "word")
    rest = F.slice("template", F.col("at") + 1, F.col("of"))
    pairs = pairs.where(F.col("at") + F.size(F.array_intersect("near", rest)) >= F.col("need"))
    starts = F.sequence(F.greatest(F.col("i") - F.col("wide") + 1, F.lit(0)), F.col("i"))
    overlap = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(F.slice("near", s + 1, F.col("wide")), F.col("template")))))
    return pairs.select("key", "label", "need", "of", overlap.alias("overlap")).where("overlap >= need").select("key", "label", (F.col("overlap") / F.col("of")).alias("containment"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs.

    A null text is empty: no words, no places (null), empty labels, score 0. score is 1 where a phrase stands in the
    text, else the highest containment that meets the threshold, else 0. Repeated rows get equal results; no rows, no
    rows. Columns other than doc_id and text are not read. The words of texts that can hold a template go to the shared
    folder, with a few numbers of all texts, so that texts are read once.
    """
    rows = texts(docs).select("doc_id", F.translate("text", UPPER, LOWER).alias("folded"))
    base = rows.select("doc_id", spaced(F.col("folded")).alias("w"))
    base = base.withColumn("n_words", F.greatest(count_words(F.col("w")) - 1, F.lit(0)).cast("long")).withColumn("split", F.split(F.col("w"), " "))
    base = base.withColumn("held", F.array_intersect(literal(vocabulary()), "split"))
    n, first, last, labels = [], [], [], []
    for phrase, label in PHRASES:
        stands, size = F.concat(F.lit(" "), F.lit(phrase), F.lit(" ")), len(phrase.split())
        there = F.contains(F.col("w"), stands)
        n.append(F.when(there, F.regexp_count("w", F.lit(f"(?<= ){phrase}(?= )")).cast("long")).otherwise(F.lit(0).cast("long")))
        first.append(F.when(there, count_words(F.substring_index("w", f" {phrase} ", 1))))
        last.append(F.when(there, F.col("n_words") - count_words(F.substring_index("w", f" {phrase} ", -1)) - size))
        labels.append(F.when(there, F.lit(label)))
    least = min(need(t) for t, _ in TEMPLATES)
    possible = F.lit(False)
    for template, _ in TEMPLATES:
        possible = possible | (F.size(F.array_intersect("held", literal(sorted(set(template.split()))))) >= need(template))
    base = base.select(
        "doc_id", F.monotonically_increasing_id().alias("key"), "n_words", sum(n[1:], n[0]).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"), "held", F.when((F.size("held") >= least) & possible, F.slice("split", 2, F.greatest(F.size("split") - 2, F.lit(0)))).alias("words"),
    )
    kept = written(base, "license-words")
    method = found_blocks(kept).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    joined = kept.drop("held", "words").join(method, "key", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def _sql() -> str:
    """All pairs of blocks and templates, but for texts that as a whole hold too few of a template's words."""
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    values = ", ".join(f"({sorted(set(t.split()))!r}, {need(t)}, {wide(t)}, {lab!r})" for t, lab in TEMPLATES)
    places = " UNION ALL ".join(
        f"SELECT rid, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r})) AS place, {lab!r} AS label FROM rows_ WHERE contains(array_to_string(w, ' '), {p!r})" for p, lab in PHRASES
    )
    return f"""
WITH folded AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
rows_ AS (SELECT rid, doc_id, {words.format("t")} AS w, t FROM folded),
places AS ({places}),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid),
templates(words, need, wide, label) AS (VALUES {values}),
pairs AS (
  SELECT rid, label, list_max(list_transform(range(1, greatest(len(w) - wide + 1, 1) + 1), lambda i: len(list_intersect(w[i : i + wide - 1], words)))) AS shared, need, len(words) AS of_
  FROM rows_, templates WHERE len(list_intersect(w, words)) >= need),
method AS (SELECT rid, label, max(shared / of_::DOUBLE) AS c FROM pairs WHERE shared >= need GROUP BY rid, label),
labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM method UNION SELECT rid, label FROM places) GROUP BY rid),
best AS (SELECT rid, max(c) AS c FROM method GROUP BY rid)
SELECT r.doc_id, len(r.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best.c, 0.0)::DOUBLE END AS score
FROM rows_ r LEFT JOIN base b USING (rid) LEFT JOIN labels l USING (rid) LEFT JOIN best USING (rid)
"""


OP6_SQL = _sql()
