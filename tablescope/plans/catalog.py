"""The registered queries of the engine's own operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import boxes as b
from ..operators import sets, tables
from ..operators import scores as s
from ..streaming import polls
from .registry import QUERIES, SQL, query
from .relations import BOXES_SQL, SCORES_SQL, TABLES_SQL, boxes, scores, shifted, table
from .relations import tables as markup_tables

#: The exact mean: numbers become decimals by their shortest text, as in the engine.
MEAN = "sum({0}::VARCHAR::DECIMAL(38,18))::VARCHAR::DOUBLE / nullif(count({0}), 0)"
SUMMARY = f"count(*) AS num_samples, {MEAN.format('teds_s')} AS teds_s, {MEAN.format('teds')} AS teds, median(teds) AS median_teds, count(*) FILTER (teds_s = 1) AS teds_s_1, count(*) FILTER (teds = 1) AS teds_1"
PAIRS = "pairs AS (SELECT a.sample, a.cls, a.document, a.teds_s AS teds_s_a, a.teds AS teds_a, b.teds_s AS teds_s_b, b.teds AS teds_b, round(b.teds_s - a.teds_s, 9) AS delta_s, round(b.teds - a.teds, 9) AS delta FROM scores_a a JOIN scores_b b USING (sample))"
BUCKET = "CASE WHEN teds = 1 THEN '1.00' WHEN teds >= 0.9 THEN '0.90-0.99' WHEN teds >= 0.7 THEN '0.70-0.89' WHEN teds >= 0.5 THEN '0.50-0.69' ELSE '<0.50' END"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.compared(scores(spark, sf_dir, "a"), scores(spark, sf_dir, "b"), ["cls", "document"])


@query(f"{SCORES_SQL} SELECT 'a' AS run, {SUMMARY} FROM scores_a UNION ALL SELECT 'b', {SUMMARY} FROM scores_b")
def q01_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = scores(spark, sf_dir, "a").withColumn("run", F.lit("a")).unionByName(scores(spark, sf_dir, "b").withColumn("run", F.lit("b")))
    return s.summary(both, ["run"])


def _sides(c: str, name: str) -> str:
    return f"count(*) FILTER ({c} > 1e-9) AS wins{name}, count(*) FILTER ({c} < -1e-9) AS losses{name}, count(*) FILTER (abs({c}) <= 1e-9) AS ties{name}"


@query(f"{SCORES_SQL}, {PAIRS} SELECT count(*) AS pairs, {MEAN.format('delta')} AS mean_delta, {MEAN.format('delta_s')} AS mean_delta_s, {_sides('delta', '')}, {_sides('delta_s', '_s')} FROM pairs")
def q02_run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.win_loss(_pairs(spark, sf_dir))


@query(f"{SCORES_SQL}, {PAIRS} SELECT sample, teds_a, teds_b, delta FROM pairs ORDER BY delta DESC, sample LIMIT 25")
def q03_top_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.largest_changes(_pairs(spark, sf_dir).select("sample", "teds_a", "teds_b", "delta"), 25)


@query(f"{SCORES_SQL} SELECT {BUCKET} AS bucket, count(*) AS n, count(*) FILTER (teds < 0.70 OR teds_s < 0.80) AS low FROM scores_a GROUP BY 1")
def q04_score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir, "a").withColumn("bucket", s.bucket(F.col("teds")))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(s.low(F.col("teds"), F.col("teds_s"))).alias("low"))


@query(f"""{SCORES_SQL}, labelled AS (SELECT {BUCKET} AS bucket, list_filter([CASE WHEN teds_s = 1 AND teds < 1 THEN 'content_only_difference' END, CASE WHEN teds_s < 1 THEN 'structural_difference' END,
  CASE WHEN teds < 0.5 THEN 'poor' END], lambda x: x IS NOT NULL) AS found FROM scores_a),
spread AS (SELECT bucket, unnest(CASE WHEN len(found) = 0 THEN ['uncategorized'] ELSE found END) AS category FROM labelled) SELECT bucket, category, count(*) AS n FROM spread GROUP BY ALL""")
def q05_category_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    teds, teds_s = F.col("teds"), F.col("teds_s")
    found = s.labels(((teds_s == 1) & (teds < 1), "content_only_difference"), (teds_s < 1, "structural_difference"), (teds < 0.5, "poor"))
    return s.crosstab(scores(spark, sf_dir, "a").select(s.bucket(teds).alias("bucket"), found.alias("found")), "found", "bucket")


@query(f"""{SCORES_SQL}, {PAIRS}, named AS (SELECT delta, teds_a, teds_b, CASE WHEN sample % 10 = 0 THEN 'other' ELSE cls END AS cls FROM pairs)
SELECT cls, count(*) AS pairs, {MEAN.format('delta')} AS mean_delta, count(*) FILTER (delta > 0.01) AS gains, count(*) FILTER (delta < -0.01) AS losses, ({MEAN.format('teds_b')}) / nullif({MEAN.format('teds_a')}, 0) AS ratio FROM named GROUP BY cls""")
def q06_class_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = scores(spark, sf_dir, "a").where("sample % 10 <> 0").select("sample", "cls")
    return s.class_deltas(_pairs(spark, sf_dir).drop("cls"), classes)


@query(f"""{SCORES_SQL}, flagged AS (SELECT a.*, c.c_mktsegment = 'BUILDING' AS flag FROM scores_a a JOIN customer c ON a.document = c.c_custkey)
SELECT 'all' AS cohort, {SUMMARY} FROM flagged UNION ALL SELECT CASE WHEN flag THEN 'flagged' ELSE 'not_flagged' END, {SUMMARY} FROM flagged GROUP BY 1""")
def q07_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document"), (F.col("c_mktsegment") == "BUILDING").alias("flag"))
    return s.cohorts(scores(spark, sf_dir, "a").join(c, "document"), "flag").where("cohort IS NOT NULL")


@query(f"""{SCORES_SQL}, items AS (SELECT l_orderkey AS sample, count(*) AS n, count(DISTINCT l_partkey % 7) AS kinds FROM lineitem GROUP BY 1),
gaps AS (SELECT a.*, (a.sample % 9 = 0) AS helps, coalesce(i.kinds, 0) % 4 AS span_gap, abs(coalesce(i.n, 0) - 4) AS row_gap, coalesce(i.n, 0) * 2 AS cell_gap FROM scores_a a LEFT JOIN items i USING (sample))
SELECT CASE WHEN helps THEN 'rotation' WHEN teds_s >= 0.9 AND teds < 0.75 THEN 'text_ocr_error' WHEN (span_gap >= 2 AND row_gap <= 4) OR (row_gap <= 2 AND cell_gap <= 8 AND teds_s < 0.9) THEN 'gt_convention_mismatch' ELSE 'structure_layout_error' END AS mode, count(*) AS n
FROM gaps WHERE teds < 0.70 OR teds_s < 0.80 GROUP BY 1""")
def q08_error_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.count("*").alias("n"), F.countDistinct(F.col("l_partkey") % 7).alias("kinds"))
    rows = scores(spark, sf_dir, "a").where(s.low(F.col("teds"), F.col("teds_s"))).join(items, "sample", "left").fillna(0, ["n", "kinds"])
    mode = s.error_mode(F.col("teds"), F.col("teds_s"), F.col("sample") % 9 == 0, F.col("kinds") % 4, F.abs(F.col("n") - 4), F.col("n") * 2)
    return rows.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query(f"""{SCORES_SQL}, variants AS (SELECT sample, r AS rotation, (((teds * 1000)::BIGINT + r * 7 * (sample % 5)) % 1001) / 1000e0 AS teds, ((teds_s * 1000)::BIGINT % 1001) / 1000e0 AS teds_s FROM scores_a, (SELECT unnest([0, 90, 270]) AS r)),
best AS (SELECT sample, arg_max(rotation, {{'a': teds, 'b': teds_s, 'c': -rotation}}) AS best, max(teds) AS best_teds, max(teds) FILTER (rotation = 0) AS baseline_teds, string_agg(rotation::VARCHAR, ',' ORDER BY rotation) AS variants FROM variants GROUP BY sample)
SELECT *, round(best_teds - baseline_teds, 9) AS gain FROM best""")
def q09_best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: F.round(F.col(c) * 1000).cast("long")
    rows = scores(spark, sf_dir, "a").withColumn("rotation", F.explode(F.array(F.lit(0), F.lit(90), F.lit(270))))
    rows = rows.select("sample", "rotation", (F.pmod(whole("teds") + F.col("rotation") * 7 * (F.col("sample") % 5), F.lit(1001)) / F.lit(1000e0)).alias("teds"), (F.pmod(whole("teds_s"), F.lit(1001)) / F.lit(1000e0)).alias("teds_s"))
    return s.best_variant(rows)


@query("""WITH a AS (SELECT doc_id, count(*) AS a FROM labels GROUP BY 1), b AS (SELECT doc_id, count(*) AS b FROM documents GROUP BY 1), f AS (SELECT * FROM a FULL JOIN b USING (doc_id))
SELECT count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (a > 1) AS repeated_left, count(*) FILTER (b > 1) AS repeated_right FROM f""")
def q10_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.key_audit(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


_RANK = "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index, count(*) OVER () AS of FROM documents)"


@query(f"{_RANK} SELECT doc_id, index, floor(((index + 1) * 8 - 1) / of)::INT AS shard FROM r")
def q11_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sets.numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return rows.select("doc_id", "index", sets.range_shard(F.col("index"), F.col("of"), 8).alias("shard"))


@query(f"{_RANK} SELECT (index % 8)::INT AS shard, count(*) AS n, min(doc_id) AS first FROM r GROUP BY 1")
def q12_modulo_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sets.numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return rows.groupBy(sets.modulo_shard(F.col("index"), 8).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""WITH per AS (SELECT o_custkey AS document, count(*) AS n, sha256('42:' || o_custkey) AS h FROM orders GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY h) - n AS before, sum(n) OVER () AS total FROM per)
SELECT document, n, CASE WHEN before < round_even(total * 0.1, 0) THEN 'validation' ELSE 'train' END AS split FROM r""")
def q13_document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.document_split(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document")), "document", 0.1)


@query(f"""{SCORES_SQL}, r AS (SELECT {BUCKET} AS bucket, sample, teds, row_number() OVER (PARTITION BY {BUCKET} ORDER BY teds DESC, sample)::INT AS rank FROM scores_a) SELECT * FROM r WHERE rank <= 5""")
def q14_top_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir, "a").select(s.bucket(F.col("teds")).alias("bucket"), "sample", "teds")
    return s.top_per_group(rows, "bucket", [F.desc("teds"), F.asc("sample")], 5)


@query(f"""{BOXES_SQL}, per AS (SELECT sample, count(*) AS regions, count(*) FILTER (text = 'N') AS empty_text, count(*) FILTER (x1 <= x0 OR y1 <= y0) AS invalid, count(*) FILTER (x1 > 61 OR y1 > 56) AS out_of_bounds FROM boxes GROUP BY 1),
f AS (SELECT s.sample AS s, p.* FROM (SELECT DISTINCT o_orderkey AS sample FROM orders) s FULL JOIN per p ON s.sample = p.sample)
SELECT count(s) AS samples, count(*) FILTER (regions IS NULL) AS empty_samples, count(*) FILTER (s IS NULL) AS extra_samples, sum(regions)::BIGINT AS regions, sum(empty_text)::BIGINT AS empty_text, sum(invalid)::BIGINT AS invalid, sum(out_of_bounds)::BIGINT AS out_of_bounds FROM f""")
def q15_region_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("text", F.when(F.col("text") != "N", F.col("text")))
    return b.validation(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample")), rows, 60, 55)


_IOU = "both_::DOUBLE / (area_a + area_b - both_)"


@query(f"""{BOXES_SQL}, sc AS (SELECT sample, idx, other, {_IOU} AS iou, both_::DOUBLE / area_a AS iop FROM pairs),
f AS (SELECT sample, idx, max(iou) AS iou, max(iop) AS iop, arg_max(other, {{'v': iou, 'o': -other}}) AS by_iou, arg_max(other, {{'v': iop, 'o': -other}}) AS by_iop FROM sc GROUP BY 1, 2),
m AS (SELECT b.sample, b.idx, f.*EXCLUDE (sample, idx), CASE WHEN iou >= 0.1 THEN 'iou' WHEN iop >= 0.1 THEN 'iop' ELSE 'none' END AS mode FROM boxes b LEFT JOIN f USING (sample, idx))
SELECT sample, idx, mode, CASE mode WHEN 'iou' THEN by_iou WHEN 'iop' THEN by_iop END AS other, CASE mode WHEN 'iou' THEN iou WHEN 'iop' THEN iop END AS value FROM m""")
def q16_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return b.best_match(rows, shifted(rows))


@query(f"""{BOXES_SQL} SELECT sample, idx, count(*) AS overlaps FROM pairs WHERE idx <> other AND both_ / least(area_a, area_b)::DOUBLE > 0.1 GROUP BY 1, 2""")
def q17_overlap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return b.overlap_flags(rows, shifted(rows))


@query(f"""{BOXES_SQL}, p AS (SELECT sample, idx, (x0 + x1) / 2e0 AS x, (y0 + y1) / 2e0 AS y FROM shifted)
SELECT p.sample, p.idx, min(b.idx) AS cell FROM p LEFT JOIN boxes b ON p.sample = b.sample AND p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1 GROUP BY 1, 2""")
def q18_point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    x, y = g.centre(F.col("box"))
    return b.first_box_of_point(shifted(rows).select("sample", "idx", x.alias("x"), y.alias("y")), rows)


@query(f"""{BOXES_SQL}, s AS (SELECT sample, idx, other, both_::DOUBLE / (area_a + area_b - both_) AS iou FROM pairs WHERE both_::DOUBLE / (area_a + area_b - both_) >= 0.5),
n AS (SELECT sample, count(*) AS n FROM boxes GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY iou DESC, idx DESC, other DESC) AS k FROM s),
walk AS (SELECT sample, list(idx ORDER BY k) AS p, list(other ORDER BY k) AS t FROM r GROUP BY 1),
fold AS (SELECT sample, list_reduce(list_transform(list_zip(p, t), lambda x: [x[1]::INT, x[2]::INT]), lambda acc, x: CASE WHEN len(list_filter(range(0, len(acc) // 2), lambda i: acc[i * 2 + 1] = x[1] OR acc[i * 2 + 2] = x[2])) > 0 THEN acc ELSE list_concat(acc, x) END) AS taken FROM walk)
SELECT n.sample, n AS pred, n AS true, coalesce(len(taken) // 2, 0)::BIGINT AS matched, coalesce(len(taken) // 2, 0) / n::DOUBLE AS precision, coalesce(len(taken) // 2, 0) / n::DOUBLE AS recall,
  CASE WHEN coalesce(len(taken) // 2, 0) > 0 THEN 2 * (len(taken) // 2 / n::DOUBLE) * (len(taken) // 2 / n::DOUBLE) / (len(taken) // 2 / n::DOUBLE + len(taken) // 2 / n::DOUBLE) ELSE 0 END AS f1 FROM n LEFT JOIN fold USING (sample)""")
def q19_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    moved = shifted(rows)
    return b.match_rates(rows, moved, b.greedy_matches(rows, moved))


@query(f"""{BOXES_SQL} SELECT sample, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) FILTER (y1 - y0 > 1.5 * (x1 - x0))::DOUBLE / count(*) AS vertical_ratio, count(*) FILTER (x1 - x0 > 1.5 * (y1 - y0))::DOUBLE / count(*) AS horizontal_ratio FROM boxes GROUP BY 1""")
def q20_union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.union_box(boxes(spark, sf_dir))


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations), n AS (SELECT conv_id, turn, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
a AS (SELECT * FROM n WHERE turn = 0), b AS (SELECT * FROM n WHERE turn = 1),
sizes AS (SELECT conv_id, sum(n) FILTER (turn = 0) AS p, sum(n) FILTER (turn = 1) AS t FROM n WHERE turn < 2 GROUP BY 1),
shared AS (SELECT conv_id, sum(least(a.n, b.n)) AS both_ FROM a JOIN b USING (conv_id, w) GROUP BY 1)
SELECT conv_id, coalesce(p, 0)::BIGINT AS pred, coalesce(t, 0)::BIGINT AS true, coalesce(both_, 0)::BIGINT AS shared, coalesce(both_, 0)::DOUBLE / greatest(coalesce(p, 0), 1) AS precision, coalesce(both_, 0)::DOUBLE / greatest(coalesce(t, 0), 1) AS recall FROM sizes LEFT JOIN shared USING (conv_id)""")
def q21_token_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two turns of each conversation are the fixture's two sides."""
    words = table(spark, sf_dir, "conversations").where("turn < 2").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    return s.bag_overlap(words, "conv_id", "turn", "w")


@query("""SELECT p_partkey, levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type), 1)::DOUBLE AS distance FROM part""")
def q22_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.normalised_distance(F.col("p_name"), F.col("p_type")).alias("distance"))


_LAN = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_CON = "regexp_replace(lower(translate({0}, 'OoIl|SsB', '00111558')), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH d AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '  ') WHEN 2 THEN replace(p_name, ' ', '') WHEN 3 THEN upper(p_name) WHEN 4 THEN replace(p_name, ' ', '-.') WHEN 5 THEN replace(replace(p_name, 'l', '1'), 'o', '0') WHEN 6 THEN '' ELSE p_type END AS b FROM part)
SELECT CASE WHEN a = b THEN 'same' WHEN trim(regexp_replace(a, '\\s+', ' ', 'g')) = trim(regexp_replace(b, '\\s+', ' ', 'g')) THEN 'whitespace_only' WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN 'spacing_only' WHEN lower(a) = lower(b) THEN 'case_only'
  WHEN {_LAN.format('a')} = {_LAN.format('b')} THEN 'punctuation_or_symbol_only' WHEN {_CON.format('a')} = {_CON.format('b')} THEN 'digit_letter_confusion_like' WHEN trim(a) = '' THEN 'parseq_empty' WHEN trim(b) = '' THEN 'master_empty' ELSE 'content_changed' END AS kind, count(*) AS n FROM d GROUP BY 1""")
def q23_text_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, k = F.col("p_name"), F.col("p_partkey") % 8
    changed = [a, F.replace(a, F.lit(" "), F.lit("  ")), F.replace(a, F.lit(" "), F.lit("")), F.upper(a), F.replace(a, F.lit(" "), F.lit("-.")), F.translate(a, "lo", "10"), F.lit(""), F.col("p_type")]
    other = F.element_at(F.array(*changed), (k + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(t.difference_class(a, other).alias("kind")).agg(F.count("*").alias("n"))


def _n(c: str, part: str) -> str:
    return f"((length({c}) - length(replace({c}, '{part}', ''))) / {len(part)})::BIGINT"


@query(f"""SELECT page_id, {_n('html', '<li')} AS items, {_n('html', '<p')} AS paragraphs, {_n('html', '<a')} AS links, length(regexp_replace(html, '<[^>]+>', '', 'g'))::INT AS text_length FROM pages""")
def q24_page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda part, name: t.occurrences(F.col("html"), part).alias(name)
    return table(spark, sf_dir, "pages").select("page_id", n("<li", "items"), n("<p", "paragraphs"), n("<a", "links"), F.length(t.without_tags(F.col("html"))).alias("text_length"))


@query(f"""{TABLES_SQL} SELECT sample, {_n('markup', '<tr>')} AS rows, {_n('markup', '<td')} AS cells, {_n('markup', 'rowspan=')} AS rowspans, {_n('markup', 'colspan=')} AS colspans, {_n('markup', '<th')} AS headers, {_n('markup', '<br')} AS breaks, {_n('markup', 'style=')} AS styles, len(regexp_extract_all(markup, '<td[^>]*>[ \\t\\r\\n]*</td>'))::BIGINT AS empty_cells FROM tables""")
def q24b_table_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_tables(spark, sf_dir).select("sample", *tables.markup_counts(F.col("markup")))


@query(f"""{TABLES_SQL}, c AS (SELECT l_orderkey AS sample, idx, unnest([0, 1, 2]) AS c0, unnest([l_partkey::VARCHAR, l_returnflag, l_linestatus]) AS text FROM items)
SELECT sample, (idx * 3 + c0)::INT AS cell_idx, idx::INT AS r0, (idx + 1)::INT AS r1, c0::INT AS c0, (c0 + 1)::INT AS c1, text FROM c""")
def q25_logical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.logical_cells(markup_tables(spark, sf_dir)).drop("header")


@query()
def q26_tree_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, true = markup_tables(spark, sf_dir, edit=True), markup_tables(spark, sf_dir)
    return tables.scored_pairs(pred, true, "canonical", parts=spark.sparkContext.defaultParallelism)


@query()
def q27_alignment_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tables.logical_cells(markup_tables(spark, sf_dir)).groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "text"))), lambda x: x["text"]).alias("cells"))
    regions = tables.logical_cells(markup_tables(spark, sf_dir, edit=True)).groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "text"))), lambda x: x["text"]).alias("regions"))
    both = cells.join(regions, "sample").repartition(spark.sparkContext.defaultParallelism, F.xxhash64("sample"))  # small rows, much work
    report = both.select("sample", tables.alignment(F.col("cells"), F.col("regions")).alias("r")).select("sample", "r.*")
    return report.groupBy("reason").agg(F.count("*").alias("n"), F.sum("cells").alias("cells"), F.sum("mapped_cells").alias("mapped_cells"), F.sum("skipped_regions").alias("skipped_regions"))


@query(f"""{BOXES_SQL}, o AS (SELECT sample, idx, x0, y0, y1, lag(y1) OVER w AS before FROM boxes WINDOW w AS (PARTITION BY sample ORDER BY y0, x0, idx))
SELECT sample, idx, (sum(CASE WHEN before IS NULL OR y0 - before > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample ORDER BY y0, x0, idx ROWS UNBOUNDED PRECEDING))::BIGINT AS line FROM o""")
def q28_line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.lines_by_gap(boxes(spark, sf_dir), 1).select("sample", "idx", "line")


@query(f"""{BOXES_SQL}, v AS (SELECT sample, idx, CASE WHEN idx % 3 <> 1 THEN x0 + idx * 50 END AS v FROM boxes),
k AS (SELECT sample, idx, v, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS p1 FROM v
  WINDOW b AS (PARTITION BY sample ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY sample ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT sample, idx, coalesce(v, v0 + (v1 - v0) * ((idx - p0)::DOUBLE / nullif(p1 - p0, 0)), v0, v1)::DOUBLE AS filled FROM k)
SELECT sample, idx, max(filled) OVER (PARTITION BY sample ORDER BY idx ROWS UNBOUNDED PRECEDING) AS filled FROM l""")
def q29_interpolated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("sample", "idx", F.when(F.col("idx") % 3 != 1, F.col("box.x0") + F.col("idx") * 50).alias("v"))
    return b.interpolated(rows, "sample", "idx", "v").select("sample", "idx", "filled")


_POLLS = "p AS (SELECT event_type, hour, least(4, n // 2) AS files FROM (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2))"


@query(f"""WITH {_POLLS}, c AS (SELECT *, CASE WHEN lag(files) OVER w IS NOT DISTINCT FROM files THEN 0 ELSE 1 END AS c FROM p WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
i AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING) AS i FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, i ORDER BY hour) AS run FROM i),
h AS (SELECT *, (files >= 1 AND run = 3) AS h FROM r), f AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING) AS f FROM h)
SELECT event_type, epoch(hour)::BIGINT AS at, files::BIGINT AS files, run::INT AS run, (h AND f = 1) AS ready FROM f""")
def q30_stable_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.least(F.lit(4), F.floor(F.count("*") / 2)).cast("long").alias("files"))
    return polls.stable_runs(counts, "event_type", "hour", "files", 1, 3).select("event_type", F.unix_timestamp("hour").alias("at"), "files", "run", "ready")


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn FROM labels)
SELECT *, (tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM c""")
def q31_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.confusion(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query("""WITH e AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:en:' || doc_id), doc_id) AS r FROM documents WHERE lang = 'en'), f AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:fr:' || doc_id), doc_id) AS r FROM documents WHERE lang = 'fr')
SELECT 'en__' || doc_id AS doc_id, 'en' AS source_dataset FROM e WHERE r <= 40 UNION ALL SELECT 'fr__' || doc_id, 'fr' FROM f WHERE r <= 10""")
def q32_replay_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sets.replay_mix([(rows.where(F.col("lang") == x).drop("lang"), x, n) for x, n in (("en", 40), ("fr", 10))], "doc_id")


@query(f"""{SCORES_SQL}, f AS (SELECT {BUCKET} AS bucket, sample, teds, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY {BUCKET}) AS of FROM scores_b WINDOW w AS (PARTITION BY {BUCKET} ORDER BY teds, sample))
SELECT bucket, sample, teds FROM f WHERE place IN (0, of // 4, of * 2 // 4, of * 3 // 4, of - 1)""")
def q33_quantile_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir, "b").withColumn("bucket", s.bucket(F.col("teds")))
    return s.quantile_picks(rows, "bucket", [F.asc("teds"), F.asc("sample")]).select("bucket", "sample", "teds")


@query("""SELECT event_type, min(epoch_us(ts)) AS first FROM events GROUP BY 1""")
def q34_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("first"))
    return sets.first_wins(rows, "event_type", [F.asc("first")])


@query()
def q35_text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.where("turn = 0").select("conv_id", F.col("text").alias("a")).join(turns.where("turn = 1").select("conv_id", F.col("text").alias("b")), "conv_id")
    return pairs.select("conv_id", t.metrics_column(F.col("a"), F.col("b")).alias("m")).select("conv_id", "m.*")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of two runs by class, beside the comparison over all."""
    pairs = _pairs(spark, sf_dir)
    by_class = s.class_deltas(pairs.drop("cls"), scores(spark, sf_dir, "a").select("sample", "cls"))
    whole = s.win_loss(pairs).select(F.col("pairs").alias("all_pairs"), F.col("mean_delta").alias("all_mean_delta"), "wins", F.col("losses").alias("all_losses"))
    return by_class.crossJoin(F.broadcast(whole))  # one row


from . import files, grids, lateral, rows  # noqa: E402, F401
