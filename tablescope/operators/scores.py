"""Summaries, comparisons and classes of scored runs. Score tables have sample, teds_s, teds and, where it is named, other columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import sets

PERFECT = 1.0


def exact_mean(column: Column) -> Column:
    """The mean from a sum of 18 decimals: the same in whatever order partitions are added. Null without rows."""
    return F.sum(column.cast("decimal(38,18)")).cast("double") / F.nullif(F.count(column), F.lit(0))


def exact_median(column: Column) -> Column:
    """As an aggregate, for groups of few different values; `medians` is for any."""
    return F.median(column)


def upper_median(column: str) -> Column:
    """Of an even number of values the larger of the two in the middle, as an aggregate."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def medians(rows: DataFrame, by: Sequence[str], value: str, middle: str = "middle", upper: str = "upper") -> DataFrame:
    """The exact median of each group, and, of an even number of values, the larger of the two in the middle.

    Equal values are counted first; the different ones are ranked in ranges, so that no task holds a group. Nulls do not count;
    groups without a value have no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = sets.cumulated(counted, by, [F.asc(value)], F.col("n"))
    at = lambda place: F.max(F.when(F.col("ahead") <= place, F.col(value)))  # noqa: E731  the last value that begins there or before
    low, high = at(F.floor((F.col("of") - 1) / 2)), at(F.floor(F.col("of") / 2))
    return placed.groupBy(*by).agg(((low.cast("double") + high.cast("double")) / 2).alias(middle), high.cast("double").alias(upper))


def same_group(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    """Null-safe equality of the columns `by`; all rows without any, where both sides have one row."""
    test = F.lit(True)
    for c in by:
        test = test & a[c].eqNullSafe(b[c])
    return test


def summary(scores: DataFrame, by: Sequence[str] = (), perfect_eps: float = 0.0) -> DataFrame:
    """Rows, means, medians and perfect scores of each group."""

    def perfect(c: str) -> Column:
        return F.count_if(F.abs(F.col(c) - PERFECT) <= perfect_eps)

    totals = scores.groupBy(*by).agg(F.count("*").alias("num_samples"), exact_mean(F.col("teds_s")).alias("teds_s"), exact_mean(F.col("teds")).alias("teds"), perfect("teds_s").alias("teds_s_1"), perfect("teds").alias("teds_1"))
    found = medians(scores, by, "teds", "median_teds").drop("upper")
    both = totals.join(found, same_group(totals, found, by), "left")
    return both.select(*[totals[c] for c in by], "num_samples", "teds_s", "teds", "median_teds", "teds_s_1", "teds_1")


def compared(a: DataFrame, b: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Both runs' scores by sample, with differences b - a rounded to nine places."""
    left = a.select("sample", *keep, F.col("teds_s").alias("teds_s_a"), F.col("teds").alias("teds_a"))
    right = b.select("sample", F.col("teds_s").alias("teds_s_b"), F.col("teds").alias("teds_b"))
    both = left.join(right, "sample")
    return both.withColumn("delta_s", F.round(F.col("teds_s_b") - F.col("teds_s_a"), 9)).withColumn("delta", F.round(F.col("teds_b") - F.col("teds_a"), 9))


def win_loss(pairs: DataFrame, by: Sequence[str] = (), eps: float = 1e-9) -> DataFrame:
    def sides(c: str, name: str) -> list[Column]:
        return [F.count_if(F.col(c) > eps).alias(f"wins{name}"), F.count_if(F.col(c) < -eps).alias(f"losses{name}"), F.count_if(F.abs(F.col(c)) <= eps).alias(f"ties{name}")]

    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), exact_mean(F.col("delta")).alias("mean_delta"), exact_mean(F.col("delta_s")).alias("mean_delta_s"), *sides("delta", ""), *sides("delta_s", "_s"))


def class_deltas(pairs: DataFrame, classes: DataFrame, missing: str = "other", least: float = 0.01) -> DataFrame:
    """By class: pairs, mean difference, how many gain or lose more than `least`, and the ratio of the mean scores. Samples without a class are `missing`."""
    named = pairs.join(classes, "sample", "left").withColumn("cls", F.coalesce("cls", F.lit(missing)))
    return named.groupBy("cls").agg(
        F.count("*").alias("pairs"), exact_mean(F.col("delta")).alias("mean_delta"), F.count_if(F.col("delta") > least).alias("gains"), F.count_if(F.col("delta") < -least).alias("losses"),
        (exact_mean(F.col("teds_b")) / F.nullif(exact_mean(F.col("teds_a")), F.lit(0.0))).alias("ratio"))


def largest_changes(pairs: DataFrame, k: int, worst: bool = False) -> DataFrame:
    order = F.asc("delta") if worst else F.desc("delta")
    return pairs.orderBy(order, "sample").limit(k)


def nearest(scores: DataFrame, target: float, k: int, column: str = "teds") -> DataFrame:
    return scores.orderBy(F.abs(F.col(column) - target), "sample").limit(k)


def near_perfect(scores: DataFrame, k: int) -> DataFrame:
    return scores.where(F.col("teds") < PERFECT).orderBy(F.desc("teds"), "sample").limit(k)


def bucket(score: Column) -> Column:
    return F.when(score == 1.0, "1.00").when(score >= 0.9, "0.90-0.99").when(score >= 0.7, "0.70-0.89").when(score >= 0.5, "0.50-0.69").otherwise("<0.50")


def low(teds: Column, teds_s: Column) -> Column:
    return (teds < 0.70) | (teds_s < 0.80)


def labels(*tests: tuple[Column, str], none: str = "uncategorized") -> Column:
    """All labels whose tests hold, in the given order."""
    found = F.array_compact(F.array(*(F.when(test, label) for test, label in tests)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(none)))


def crosstab(rows: DataFrame, label_array: str, by: str) -> DataFrame:
    """Rows by each of their labels and one more column, without empty cells."""
    return rows.select(by, F.explode(label_array).alias("category")).groupBy(by, "category").agg(F.count("*").alias("n"))


def top_per_group(rows: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def quantile_picks(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The rows at 0, 1/4, 1/2, 3/4 and the end of each group's order, which is total; groups of any size, in ranges."""
    placed = sets.cumulated(rows, [group], order, F.lit(1).cast("long"))
    wanted = F.array(F.lit(0).cast("long"), *(F.floor(F.col("of") * q / 4) for q in (1, 2, 3)), F.col("of") - 1)
    return placed.where(F.array_contains(wanted, F.col("ahead")))


def cohorts(scores: DataFrame, flag: str) -> DataFrame:
    """The summary of all rows, of flagged and of other rows, from one pass over groups."""
    each = F.explode(F.array(F.lit("all"), F.when(F.col(flag), "flagged").otherwise("not_flagged"))).alias("cohort")
    return summary(scores.select(each, "teds_s", "teds"), ["cohort"])


def best_variant(scores: DataFrame, group: str = "sample", variant: str = "rotation", baseline: int = 0) -> DataFrame:
    """Each group's best variant by (teds, teds_s), the first of equals; the baseline's score; and the gain."""
    key = F.struct("teds", "teds_s", -F.col(variant))
    out = scores.groupBy(group).agg(F.max_by(variant, key).alias("best"), F.max("teds").alias("best_teds"), F.max(F.when(F.col(variant) == baseline, F.col("teds"))).alias("baseline_teds"), F.array_join(F.array_sort(F.collect_list(variant)), ",").alias("variants"))
    return out.withColumn("gain", F.round(F.col("best_teds") - F.col("baseline_teds"), 9))


def error_mode(teds: Column, teds_s: Column, rotation_helps: Column, span_gap: Column, row_gap: Column, cell_gap: Column) -> Column:
    return (
        F.when(rotation_helps, "rotation")
        .when((teds_s >= 0.90) & (teds < 0.75), "text_ocr_error")
        .when(((span_gap >= 2) & (row_gap <= 4)) | ((row_gap <= 2) & (cell_gap <= 8) & (teds_s < 0.90)), "gt_convention_mismatch")
        .otherwise("structure_layout_error")
    )


def quality_tier(coverage: Column, similarity: Column, good: tuple[float, float] = (0.9, 0.9), fair: tuple[float, float] = (0.6, 0.6)) -> Column:
    return F.when((coverage >= good[0]) & (similarity >= good[1]), "promising").when((coverage >= fair[0]) & (similarity >= fair[1]), "manual_check").otherwise("weak")


def first_reason(*tests: tuple[Column, str], otherwise: str = "accepted") -> Column:
    """The label of the first test that holds."""
    out = F.lit(otherwise)
    for test, label in reversed(tests):
        out = F.when(test, label).otherwise(out)
    return out


def confusion(rows: DataFrame, predicted: Column, true: Column) -> DataFrame:
    """Counts, accuracy, precision and recall; null where nothing can be divided by."""
    counts = rows.agg(F.count_if(predicted & true).alias("tp"), F.count_if(predicted & ~true).alias("fp"), F.count_if(~predicted & true).alias("fn"), F.count_if(~predicted & ~true).alias("tn"))
    ratio = lambda a, b: a.cast("double") / F.nullif(b, F.lit(0))
    c = F.col
    return counts.select("tp", "fp", "fn", "tn", ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")).alias("accuracy"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1))


def adjusted(old: Column, equal: Column, nodes: Column, inserted: Column) -> Column:
    """An approximation, never a rescoring: the old distance, less the nodes that only one convention has, over the larger tree. Equal markup is 1."""
    distance = F.greatest((1 - old) * nodes - inserted, F.lit(0.0))
    return F.when(equal, F.lit(1.0)).otherwise(F.greatest(1 - distance / F.greatest(nodes, F.lit(1)), F.lit(0.0)))


def one_policy(scores: DataFrame) -> DataFrame:
    """The rows, if all were scored under one policy; scores of several are not comparable."""
    found = [r[0] for r in scores.select("policy").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"scores of several policies: {sorted(map(str, found))}")
    return scores


BENCHMARK = ("teds", "teds_s", "ap50", "cell_precision_iou50", "cell_recall_iou50", "cell_f1_iou50")
MEDIANS = ("teds", "teds_s", "ap50")


def model_benchmark(rows: DataFrame, by: str = "model", status: str = "status", missing: str = "missing_prediction") -> DataFrame:
    """By model: tables in all, evaluated and without a prediction, and means, of some metrics medians too, over the evaluated ones."""
    done = F.col(status) != missing
    value = lambda c: F.when(done, F.col(c))
    counts = [F.count("*").alias("tables_total"), F.count_if(done).alias("tables_evaluated"), F.count_if(~done).alias("tables_missing_prediction")]
    return rows.groupBy(by).agg(*counts, *(exact_mean(value(c)).alias(f"{c}_mean") for c in BENCHMARK), *(F.median(value(c)).alias(f"{c}_median") for c in MEDIANS))


COMPARED_MEANS = ("compact_char_similarity", "token_f1", "token_precision", "token_recall", "extra_token_ratio", "missing_token_ratio", "char_bag_f1", "cer", "wer")


def comparison_summary(rows: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Of text metrics, a row for each sample and source: nine means, two medians and two counts by source, or by source and score group."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("samples"), *(exact_mean(F.col(c)).alias(f"mean_{c}") for c in COMPARED_MEANS), F.median("compact_char_similarity").alias("median_compact_char_similarity"), F.median("length_ratio").alias("median_length_ratio"),
        F.count_if(F.col("exact")).alias("exact_tables"), F.count_if(F.col("compact_exact")).alias("compact_exact_tables"),
    )


def score_group(teds: Column, good: float = 0.9, bad: float = 0.7) -> Column:
    """`good`, `bad`, or null between the two and without a score."""
    return F.when(teds >= good, "good").when(teds < bad, "bad")


def match_rollup(matches: DataFrame) -> DataFrame:
    """Of one row for each region (sample, mode; `none`: without a match): regions, matched ones, their rate, a count for each way of matching, and the mean of the samples' rates. Null rates without rows."""
    hit = F.col("mode") != "none"
    per = matches.groupBy("sample").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(F.col("mode") == "iou").alias("by_iou"), F.count_if(F.col("mode") == "iop").alias("by_iop"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        F.count("*").alias("samples"), total("n").alias("regions"), total("hits").alias("matched"), total("by_iou").alias("by_iou"), total("by_iop").alias("by_iop"),
        (F.sum("hits") / F.nullif(F.sum("n"), F.lit(0))).alias("rate"), exact_mean(F.round(F.col("hits") / F.col("n"), 9)).alias("mean_rate"),
    )


def mean_where(value: Column, test: Column) -> Column:
    """The mean of the values whose test holds and that are not null; 0 without any."""
    return F.coalesce(exact_mean(F.when(test, value)), F.lit(0.0))


def list_totals(rows: DataFrame, lists: str) -> DataFrame:
    """Rows, elements of all lists, and rows whose list is empty or null."""
    n = F.greatest(F.coalesce(F.size(lists), F.lit(0)), F.lit(0))
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("elements"), F.count_if(n == 0).alias("empty"))


def split_counts(rows: DataFrame, split: str, fits: Column) -> DataFrame:
    return rows.groupBy(split).agg(F.count("*").alias("n"), F.count_if(fits).alias("fitting"))


def distinct_counts(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Different values of some columns, nulls left out, by group."""
    return rows.groupBy(*by).agg(*(F.count_distinct(c).alias(c) for c in columns))


def diagnostic_priority(similarity: Column, partial: Column, spans: Column) -> Column:
    """What a person should look at first: dissimilar, partly covered and spanned tables."""
    return (1 - similarity) + 0.25 * F.least(partial, F.lit(3)) + 0.05 * F.least(spans, F.lit(3))


#: Counts, by markup_statistics, that two tables may differ in, and the labels of it; in the fixed order.
COUNT_LABELS = (("tr", "row_count_mismatch"), ("td", "cell_count_mismatch"), ("rowspan", "rowspan_count_mismatch"), ("colspan", "colspan_count_mismatch"), ("empty_td", "empty_cell_count_mismatch"))


def difference_labels(raw_pred: Column, raw_true: Column, pred: Column, true: Column, teds_s: Column, teds: Column) -> Column:
    """All of nine labels that hold for two tables' statistics, raw and normalised, and their scores; `uncategorized` if none does."""
    differs = lambda a, b, *names: F.lit(False) if not names else (a[names[0]] != b[names[0]]) | differs(a, b, *names[1:])
    tests = [
        (differs(raw_pred, raw_true, "thead", "tbody"), "raw_section_convention_mismatch"),
        (differs(pred, true, "thead_tr", "tbody_tr"), "normalized_thead_tbody_split_mismatch"),
        *((differs(pred, true, name), label) for name, label in COUNT_LABELS),
        ((teds_s == 1.0) & (teds < 1.0), "content_only_difference"),
        (teds_s < 1.0, "structural_difference"),
    ]
    return labels(*tests)


def pseudo_label_reason(has_text: Column, has_structure: Column, cells: Column, regions: Column, coverage: Column, similarity: Column, most_cells: int = 400, least_coverage: float = 0.78, least_similarity: float = 0.82) -> Column:
    """Why a table makes no training label: the first of six reasons, or `accepted`."""
    return first_reason(
        (~has_text, "missing_ocr"), (~has_structure, "html_or_otsl"), ((F.coalesce(cells, F.lit(0)) == 0) | (cells > most_cells), "cell_count"), (F.coalesce(regions, F.lit(0)) == 0, "no_regions"),
        (coverage < least_coverage, "low_coverage"), (similarity < least_similarity, "low_similarity"),
    )


def bag_overlap(words: DataFrame, key: str, side: str, word: str) -> DataFrame:
    """Of words on two sides (`side` 0 and 1) of each key: how many there are, how many they share as multisets, and precision and recall. Counts are added up before the sides meet."""
    per = words.groupBy(key, word).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    out = per.groupBy(key).agg(F.sum("a").alias("pred"), F.sum("b").alias("true"), F.sum(F.least("a", "b")).alias("shared"))
    share = lambda c: F.col("shared").cast("double") / F.greatest(F.col(c), F.lit(1))
    return out.select("*", share("pred").alias("precision"), share("true").alias("recall"))
