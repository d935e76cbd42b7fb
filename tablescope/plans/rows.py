"""Queries over relations: joins, sets, orders, aggregates, text and geometry in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import boxes as b
from ..operators import reconstruct, select, sets, training
from ..operators import scores as s
from .registry import query
from .relations import BOXES_SQL, SCORES_SQL, boxes, scores, shifted, table

MEAN = "sum({0}::VARCHAR::DECIMAL(38,18))::VARCHAR::DOUBLE / nullif(count({0}), 0)"


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "lang", "source", "n_chars")))


# Predicates


@query("SELECT p_partkey::BIGINT AS k FROM part WHERE p_size BETWEEN 5 AND 20 AND p_retailprice <= 1500")
def q111_shape_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.shaped(table(spark, sf_dir, "part"), {"p_size": (5, 20), "p_retailprice": (None, 1500)}).select(F.col("p_partkey").cast("long").alias("k"))


@query(f"{SCORES_SQL} SELECT sample, teds FROM scores_a WHERE teds >= 0.5 AND teds < 0.7")
def q112_score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.band(scores(spark, sf_dir, "a"), "teds", 0.5, 0.7).select("sample", "teds")


@query(f"{BOXES_SQL}, u AS (SELECT sample, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h, count(*) FILTER (y1 - y0 > 1.5 * (x1 - x0)) / count(*)::DOUBLE AS v FROM boxes GROUP BY 1) SELECT sample FROM u WHERE h >= 2.0 * w OR v >= 0.65")
def q113_rotation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.rotation_candidates(boxes(spark, sf_dir)).select("sample")


@query(f"{BOXES_SQL} SELECT sample, idx FROM boxes WHERE idx % 4 IN (0, 1) AND text <> 'N'")
def q114_valid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.lit(1.0), F.col("idx") % 4
    numbers = F.when(i == 0, F.array_repeat(n, 4)).when(i == 1, F.array_repeat(n, 8)).when(i == 2, F.array_repeat(n, 5))
    rows = boxes(spark, sf_dir).select("sample", "idx", numbers.alias("bbox"), F.when(F.col("text") != "N", F.col("text")).otherwise(" ").alias("text"))
    return b.valid_regions(rows).select("sample", "idx")


@query("""SELECT doc_id, list_filter([CASE WHEN lang IS NULL OR lang = 'fr' THEN 'lang' END, CASE WHEN n_chars <= 500 OR n_chars IS NULL THEN 'text' END], lambda x: x IS NOT NULL) AS missing, doc_id % 5 <> 0 AS coord_valid, coalesce(doc_id % 7 = 0, false) AS overlaps_fixed_test,
  doc_id % 5 <> 0 AND lang <> 'fr' AND n_chars > 500 AS valid_for_split FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL AND doc_id IS NOT NULL""")
def q115_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).select("doc_id", "missing", "coord_valid", "overlaps_fixed_test", "valid_for_split")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("lang IS NOT NULL AND n_chars IS NOT NULL AND doc_id IS NOT NULL")
    side = lambda c: F.when((F.col("doc_id") % 5 != 0) | F.lit(c != "bottom"), 1.0).alias(c)
    rows = docs.withColumn("coords", F.struct(*map(side, training.COORDINATES)))
    return training.inventory(rows, {"lang": F.col("lang") != "fr", "text": F.col("n_chars") > 500}, "coords", "doc_id", docs.where("doc_id % 7 = 0").select("doc_id"))


@query("""WITH d AS (SELECT * FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL AND doc_id IS NOT NULL)
SELECT CASE WHEN doc_id % 7 = 0 THEN 'test_overlap' WHEN doc_id % 5 = 0 OR lang = 'fr' OR n_chars <= 500 THEN 'invalid' WHEN doc_id % 3 = 0 THEN 'validation' WHEN doc_id % 3 = 1 THEN 'train' ELSE 'invalid' END AS split, count(*) AS n FROM d GROUP BY 1""")
def q116_assigned_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _docs(spark, sf_dir, "doc_id").distinct().where("doc_id % 3 < 2").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train"))
    return training.assigned(_inventory(spark, sf_dir), split, "doc_id").groupBy("split").agg(F.count("*").alias("n"))


@query(f"{SCORES_SQL} SELECT CASE WHEN teds_s >= 0.9 AND teds >= 0.9 THEN 'promising' WHEN teds_s >= 0.6 AND teds >= 0.6 THEN 'manual_check' ELSE 'weak' END AS tier, count(*) AS n FROM scores_a GROUP BY 1")
def q117_quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "a").groupBy(s.quality_tier(F.col("teds_s"), F.col("teds")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::BIGINT AS k, upper(n_name) AS name, n_name AS original_name, 'upper' AS name_source FROM nation")
def q118_replaced_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    return sets.replaced(rows, "name", F.upper("name"), "upper")


@query("SELECT r_regionkey::BIGINT AS key, r_name AS a_name, n.n AS b_n FROM region LEFT JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation WHERE n_regionkey <> 2 GROUP BY 1) n USING (r_regionkey)")
def q119_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    c = table(spark, sf_dir, "nation").where("n_regionkey <> 2").groupBy(F.col("n_regionkey").cast("long").alias("key")).agg(F.count("*").alias("n"))
    return sets.side_by_side([(a, "a_"), (c, "b_")], "key", "left")


@query("SELECT o_orderkey::BIGINT AS k, 'allowed' AS list FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT o_orderkey, 'not denied' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q120_allow_and_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").alias("c"))
    names = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("c"))
    each = lambda denied, name: sets.only_named(rows, names, "c", denied).select("k", F.lit(name).alias("list"))
    return each(False, "allowed").union(each(True, "not denied"))


@query("SELECT r_regionkey::BIGINT AS k FROM region")
def q121_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass a gate, a count, a test of uniqueness and one of completeness."""
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"))
    sets.require_all(rows, rows, "k")
    return sets.gate(sets.require_unique(select.require_count(rows, 5), "k"), F.count("*") > 0, "no regions")


@query(f"""{BOXES_SQL}, k AS (SELECT sample, idx, text, x0, row_number() OVER (PARTITION BY sample ORDER BY idx) - 1 AS region_idx FROM boxes WHERE sample % 3 = 0 AND text <> 'N') SELECT sample, region_idx::INT AS region_idx, text, x0, 1e0 AS score FROM k""")
def q122_cell_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.when(F.col("sample") % 3 == 0, "promising").otherwise("weak")
    cells = boxes(spark, sf_dir).select("sample", quality.alias("quality"), F.col("idx").alias("cell_idx"), F.when(F.col("text") != "N", F.col("text")).alias("text"), "box")
    return b.cell_regions(cells, "promising").select("sample", "region_idx", "text", F.col("box.x0").alias("x0"), "score")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('42:' || o_orderkey), o_orderkey) AS r FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) SELECT o_orderkey::BIGINT AS k FROM r WHERE r <= 20")
def q123_visible_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").alias("c"))
    flagged = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("c"))
    return select.visible_sample(rows, "c", flagged, "k", 20).select("k")


# Joins


@query("SELECT o_orderkey::BIGINT AS key, o_custkey::BIGINT AS a_c, n AS b_n, q AS c_q FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey) JOIN (SELECT l_orderkey AS o_orderkey, max(l_linenumber)::BIGINT AS q FROM lineitem WHERE l_quantity > 40 GROUP BY 1) USING (o_orderkey)")
def q124_key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").cast("long").alias("key")
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key"), F.col("o_custkey").cast("long").alias("c"))
    return sets.side_by_side([(a, "a_"), (li.groupBy(key).agg(F.count("*").alias("n")), "b_"), (li.where("l_quantity > 40").groupBy(key).agg(F.max("l_linenumber").cast("long").alias("q")), "c_")], "key")


@query(f"{SCORES_SQL}, d AS (SELECT DISTINCT l_orderkey AS sample FROM lineitem WHERE l_quantity > 45) SELECT status, count(*) AS n FROM (SELECT a.sample, CASE WHEN d.sample IS NULL THEN 'missing_prediction' ELSE 'evaluated' END AS status FROM scores_a a LEFT JOIN d USING (sample)) GROUP BY 1")
def q125_join_with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("sample")).distinct()
    return sets.with_status(scores(spark, sf_dir, "a"), done, "sample").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT 'joined' AS part, count(*) AS n FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'unmatched', count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))")
def q126_joined_and_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, left = sets.joined_and_unmatched(_docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    n = lambda rows, name: rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n(both, "joined").union(n(left, "unmatched"))


@query("SELECT p_partkey::BIGINT AS k, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand FROM part")
def q127_right_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("long").alias("k")
    return sets.merged(p.select(k, F.col("p_name").alias("name")), p.where("p_partkey % 3 = 0").select(k, F.col("p_type").alias("name"), F.col("p_brand").alias("brand")), "k")


@query("SELECT o_orderkey::BIGINT AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def q128_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("k"))
    return sets.only_named(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), keys, "k").select(F.col("k").cast("long"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q129_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.unmatched(_docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT n_nationkey::BIGINT AS k, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def q130_derived_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`..._2` on one side, `x__2` on the other."""
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.concat(F.lit("a_b_"), F.col("n_regionkey").cast("string")).alias("name"))
    c = table(spark, sf_dir, "region").select(F.concat(F.lit("x__"), F.col("r_regionkey").cast("string")).alias("file"), F.col("r_name").alias("region"))
    return sets.derived_key_join(a, c, sets.after_last(F.col("name"), "_"), sets.after_first(F.col("file"), "__")).select("k", "region")


@query("SELECT sample, place::INT AS place, a, b FROM (SELECT o_orderkey AS sample, unnest([0, 1]) AS place, unnest([o_orderstatus, o_orderpriority]) AS a, unnest([o_custkey::VARCHAR, o_orderstatus]) AS b FROM orders)")
def q131_positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").alias("sample")
    a = o.select(key, F.array("o_orderstatus", "o_orderpriority", F.lit("more")).alias("v"))
    return sets.positional_join(a, o.select(key, F.array(F.col("o_custkey").cast("string"), F.col("o_orderstatus")).alias("v")), "sample", "v").select("sample", "place", "a", "b")


@query(f"{BOXES_SQL} SELECT sample, idx, other, both_ / area_a::DOUBLE AS share FROM pairs")
def q132_overlap_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return b.overlap_shares(rows, shifted(rows))


@query(f"{BOXES_SQL} SELECT a.sample, a.idx, b.idx AS other FROM boxes a JOIN shifted b ON a.sample = b.sample AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def q133_closed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return b.pairs(rows, shifted(rows), g.touches(F.col("box"), F.col("other_box"))).select("sample", "idx", "other")


@query(f"{BOXES_SQL} SELECT sample, idx FROM boxes WHERE (x0 + x1) / 2e0 BETWEEN 10 AND 40 AND (y0 + y1) / 2e0 BETWEEN 10 AND 30")
def q134_centre_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = g.box(F.lit(10), F.lit(10), F.lit(40), F.lit(30))
    return boxes(spark, sf_dir).where(g.contains_point(place, *g.centre(F.col("box")))).select("sample", "idx")


# Aggregates


_STATUS = "st AS (SELECT a.*, CASE WHEN sample % 6 = 0 THEN 'missing_prediction' ELSE 'evaluated' END AS status FROM scores_a a)"


@query(f"""{SCORES_SQL}, {_STATUS}, v AS (SELECT cls AS model, status, CASE WHEN status = 'evaluated' THEN teds END AS t, CASE WHEN status = 'evaluated' THEN teds_s END AS s FROM st)
SELECT model, count(*) AS tables_total, count(*) FILTER (status = 'evaluated') AS tables_evaluated, count(*) FILTER (status <> 'evaluated') AS tables_missing_prediction, {MEAN.format('t')} AS teds_mean, {MEAN.format('s')} AS teds_s_mean, {MEAN.format('t')} AS ap50_mean,
  {MEAN.format('s')} AS cell_precision_iou50_mean, {MEAN.format('t')} AS cell_recall_iou50_mean, {MEAN.format('s')} AS cell_f1_iou50_mean, median(t) AS teds_median, median(s) AS teds_s_median, median(t) AS ap50_median FROM v GROUP BY 1""")
def q136_model_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir, "a").withColumn("status", F.when(F.col("sample") % 6 == 0, "missing_prediction").otherwise("evaluated")).withColumn("model", F.col("cls"))
    named = {"ap50": "teds", "cell_precision_iou50": "teds_s", "cell_recall_iou50": "teds", "cell_f1_iou50": "teds_s"}
    return s.model_benchmark(rows.withColumns({k: F.col(v) for k, v in named.items()}))


@query(f"{SCORES_SQL}, w AS (SELECT cls, teds, 1 + sample % 4 AS w FROM scores_a) SELECT cls, sum((teds * 1000)::BIGINT * w)::BIGINT AS total, (sum((teds * 1000)::BIGINT * w) / greatest(sum(w), 1)::DOUBLE) AS mean FROM w GROUP BY 1")
def q137_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, w = F.round(F.col("teds") * 1000).cast("long"), 1 + F.col("sample") % 4
    return scores(spark, sf_dir, "a").groupBy("cls").agg(F.sum(whole * w).alias("total"), s.weighted_mean(whole, w).alias("mean"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def q138_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.distinct_counts(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_custkey", "o_orderpriority"])


@query("""SELECT split, category, count(*) AS n FROM (SELECT lang AS split, unnest(list_filter([CASE WHEN n_chars <= 500 THEN 'short' END, CASE WHEN source IS NULL THEN 'source' END, CASE WHEN n_chars % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS category FROM documents) GROUP BY ALL""")
def q139_missing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    reasons = F.array_compact(F.array(F.when(n <= 500, "short"), F.when(F.col("source").isNull(), "source"), F.when(n % 2 == 0, "even")))
    return s.crosstab(_docs(spark, sf_dir).select(F.col("lang").alias("split"), reasons.alias("r")), "r", "split")


@query("SELECT count(*) AS rows, coalesce(sum(len(embedding)), 0)::BIGINT AS elements, count(*) FILTER (coalesce(len(embedding), 0) = 0) AS empty FROM embeddings")
def q140_list_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.list_totals(table(spark, sf_dir, "embeddings"), "embedding")


@query(f"""{BOXES_SQL}, f AS (SELECT sample, idx, max(both_::DOUBLE / (area_a + area_b - both_)) AS iou, max(both_::DOUBLE / area_a) AS iop FROM pairs GROUP BY 1, 2),
m AS (SELECT b.sample, CASE WHEN iou >= 0.1 THEN 'iou' WHEN iop >= 0.1 THEN 'iop' ELSE 'none' END AS mode FROM boxes b LEFT JOIN f USING (sample, idx)),
p AS (SELECT sample, count(*) AS n, count(*) FILTER (mode <> 'none') AS hits, count(*) FILTER (mode = 'iou') AS by_iou, count(*) FILTER (mode = 'iop') AS by_iop, round(count(*) FILTER (mode <> 'none') / count(*)::DOUBLE, 9) AS rate FROM m GROUP BY 1)
SELECT count(*) AS samples, sum(n)::BIGINT AS regions, sum(hits)::BIGINT AS matched, sum(by_iou)::BIGINT AS by_iou, sum(by_iop)::BIGINT AS by_iop, sum(hits) / sum(n)::DOUBLE AS rate, {MEAN.format('rate')} AS mean_rate FROM p""")
def q141_match_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return s.match_rollup(b.best_match(rows, shifted(rows)))


@query(f"{SCORES_SQL}, c AS (SELECT cls, CASE WHEN sample % 3 = 0 THEN teds END AS t FROM scores_a) SELECT cls, coalesce({MEAN.format('t')}, 0) AS mean FROM c GROUP BY 1")
def q142_conditional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "a").groupBy("cls").agg(s.mean_where(F.col("teds"), F.col("sample") % 3 == 0).alias("mean"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars BETWEEN 100 AND 1000) AS fitting FROM documents GROUP BY 1")
def q143_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.split_counts(_docs(spark, sf_dir), "lang", F.col("n_chars").between(100, 1000))


@query(f"{SCORES_SQL} SELECT cls, (sample % 2)::BIGINT AS policy, count(*) AS num_samples, {MEAN.format('teds_s')} AS teds_s, {MEAN.format('teds')} AS teds, median(teds) AS median_teds, count(*) FILTER (abs(teds_s - 1) <= 0.001) AS teds_s_1, count(*) FILTER (abs(teds - 1) <= 0.001) AS teds_1 FROM scores_a GROUP BY ALL")
def q144_report_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.summary(scores(spark, sf_dir, "a").withColumn("policy", (F.col("sample") % 2).cast("long")), ["cls", "policy"], perfect_eps=0.001)


@query(f"{BOXES_SQL}, r AS (SELECT sample, x0, row_number() OVER (PARTITION BY sample ORDER BY x0) - 1 AS k, count(*) OVER (PARTITION BY sample) AS n FROM boxes) SELECT sample, max(x0) FILTER (k = n // 2)::DOUBLE AS upper, median(x0) AS middle FROM r GROUP BY 1")
def q145_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.medians(boxes(spark, sf_dir).select("sample", F.col("box.x0").alias("x0")), ["sample"], "x0")


_METRICS = ("compact_char_similarity", "token_f1", "token_precision", "token_recall", "extra_token_ratio", "missing_token_ratio", "char_bag_f1", "cer", "wer")


@query(f"""{SCORES_SQL}, u AS (SELECT 'a' AS source, a.* FROM scores_a a UNION ALL SELECT 'b', b.* FROM scores_b b), g AS (SELECT *, CASE WHEN teds >= 0.9 THEN 'good' WHEN teds < 0.7 THEN 'bad' END AS grp FROM u)
SELECT source, grp, count(*) AS samples, {', '.join(f"{MEAN.format('teds' if k % 2 else 'teds_s')} AS mean_{m}" for k, m in enumerate(_METRICS))}, median(teds_s) AS median_compact_char_similarity, median(teds) AS median_length_ratio, count(*) FILTER (teds = 1) AS exact_tables, count(*) FILTER (teds_s = 1) AS compact_exact_tables FROM g GROUP BY ALL""")
def q146_comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = scores(spark, sf_dir, "a").withColumn("source", F.lit("a")).union(scores(spark, sf_dir, "b").withColumn("source", F.lit("b")))
    named = {m: F.col("teds" if k % 2 else "teds_s") for k, m in enumerate(_METRICS)}
    rows = both.withColumns(named | {"length_ratio": F.col("teds"), "exact": F.col("teds") == 1, "compact_exact": F.col("teds_s") == 1, "grp": s.score_group(F.col("teds"))})
    return s.comparison_summary(rows, ["source", "grp"])


@query(f"{SCORES_SQL} SELECT sample, CASE WHEN sample % 4 = 0 THEN 1e0 ELSE greatest(1 - greatest((1 - teds) * (sample % 50) - sample % 5, 0e0) / greatest(sample % 50, 1), 0e0) END AS adjusted FROM scores_a")
def q147_adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("sample")
    return scores(spark, sf_dir, "a").select("sample", s.adjusted(F.col("teds"), k % 4 == 0, k % 50, k % 5).alias("adjusted"))


@query(f"{SCORES_SQL} SELECT sample, (1 - teds) + 0.25e0 * least(sample % 6, 3) + 0.05e0 * least(sample % 5, 3) AS priority FROM scores_a")
def q148_diagnostic_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "a").select("sample", s.diagnostic_priority(F.col("teds"), F.col("sample") % 6, F.col("sample") % 5).alias("priority"))


@query(f"{SCORES_SQL} SELECT sample, teds, 'canonical' AS policy FROM scores_a")
def q149_one_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.one_policy(scores(spark, sf_dir, "a").select("sample", "teds", F.lit("canonical").alias("policy")))


# Distinct, windows, orders, sets


@query("SELECT o_custkey, min(o_orderkey)::BIGINT AS first FROM orders GROUP BY 1")
def q150_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.first_seen(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("long").alias("first")), "o_custkey", "first")


@query("SELECT doc_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT -o_custkey, count(*) FROM orders GROUP BY 1 HAVING count(*) > 1")
def q151_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.duplicates(_docs(spark, sf_dir, "doc_id"), "doc_id").union(sets.duplicates(table(spark, sf_dir, "orders").select((-F.col("o_custkey")).alias("doc_id")), "doc_id"))


@query("SELECT o_custkey::BIGINT AS c, max(o_orderkey)::BIGINT AS k FROM orders GROUP BY 1")
def q152_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.last_wins(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("c"), F.col("o_orderkey").cast("long").alias("k")), "c", [F.col("k")])


@query(f"""{BOXES_SQL}, d AS (SELECT sample, x0, CASE WHEN x0 - lag(x0) OVER w <= 3 THEN 0 ELSE 1 END AS b FROM boxes WINDOW w AS (PARTITION BY sample ORDER BY x0)), r AS (SELECT sample, x0, sum(b) OVER (PARTITION BY sample ORDER BY x0) AS run FROM d)
SELECT sample, run::INT AS run, min(x0) AS first, max(x0) AS last, round_even(median(x0), 0)::BIGINT AS centre, sum(x0) / count(*)::DOUBLE AS mean FROM r GROUP BY 1, 2""")
def q153_merged_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.merged_positions(boxes(spark, sf_dir).select("sample", F.col("box.x0").alias("x0")), "x0", 3)


#: Position after position: the first cluster whose mean is near, else a new one; ms and ns: means and sizes of a sample's clusters.
_CLUSTERS = f"""{BOXES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT sample, idx, y0::DOUBLE AS v, row_number() OVER (PARTITION BY sample ORDER BY y0, idx) AS k FROM boxes),
walk AS (SELECT sample, 0::BIGINT AS k, 0::INT AS idx, 0::BIGINT AS c, []::DOUBLE[] AS ms, []::DOUBLE[] AS ns FROM (SELECT DISTINCT sample FROM o)
  UNION ALL SELECT sample, k, idx, c, list_transform(range(1, greatest(len(ms), c) + 1), lambda i: CASE WHEN i <> c THEN ms[i] WHEN i > len(ms) THEN v ELSE ms[i] + (v - ms[i]) / (ns[i] + 1) END), list_transform(range(1, greatest(len(ms), c) + 1), lambda i: CASE WHEN i <> c THEN ns[i] WHEN i > len(ns) THEN 1 ELSE ns[i] + 1 END)
  FROM (SELECT w.sample, o.k, o.idx, o.v, w.ms, w.ns, coalesce(list_filter(range(1, len(w.ms) + 1), lambda i: abs(o.v - w.ms[i]) <= 4)[1], len(w.ms) + 1) AS c FROM walk w JOIN o ON o.sample = w.sample AND o.k = w.k + 1))"""


@query(f"{_CLUSTERS} SELECT sample, idx, (c - 1)::INT AS cluster FROM walk WHERE k > 0")
def q154_running_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper edges that join clusters whose means drift."""
    return b.cluster_positions(boxes(spark, sf_dir).select("sample", "idx", F.col("box.y0").cast("double").alias("y")), "y", 4)


@query("SELECT 'run/checkpoint-' || max(o_orderkey) AS path, max(o_orderkey)::BIGINT AS step FROM orders WHERE o_orderkey % 2 = 0")
def q155_latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.when(k % 2 == 0, "run/checkpoint-").otherwise("run/other-"), k.cast("string")).alias("path"))
    return sets.latest(rows, "path", "checkpoint-([0-9]+)$")


@query(f"{SCORES_SQL} SELECT sample, teds FROM scores_a ORDER BY abs(teds - 0.5), sample LIMIT 12")
def q156_nearest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.nearest(scores(spark, sf_dir, "a"), 0.5, 12).select("sample", "teds")


@query(f"{SCORES_SQL} SELECT sample, teds FROM scores_a WHERE teds < 1 ORDER BY teds DESC, sample LIMIT 12")
def q157_near_perfect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.near_perfect(scores(spark, sf_dir, "a"), 12).select("sample", "teds")


@query(f"{SCORES_SQL} SELECT sample FROM scores_a ORDER BY CASE WHEN teds_s < 0.1 THEN 0 ELSE 1 END, sample % 97 DESC, sample LIMIT 15")
def q158_problems_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.problems_first(scores(spark, sf_dir, "a"), F.col("teds_s") < 0.1, F.col("sample") % 97, "sample").select("sample").limit(15)


@query("SELECT o_orderkey::BIGINT AS k FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 40")
def q159_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.page(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k")), ["k"], 40, 30)


@query("SELECT o_orderkey::BIGINT AS k FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25")
def q160_first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.first_accepted(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", ["o_orderkey"], 25).select(F.col("o_orderkey").cast("long").alias("k"))


@query("SELECT n_nationkey::BIGINT AS k FROM nation ORDER BY n_nationkey LIMIT 1000 OFFSET 5")
def q161_page_without_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.page(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")), ["k"], 5, 0)


@query(f"{BOXES_SQL}, r AS (SELECT sample, idx, CASE WHEN idx % 3 <> 0 THEN idx / 8e0 END AS score FROM boxes), k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY coalesce(score, 1e0), idx) AS n FROM r) SELECT sample, idx AS region_idx, coalesce(score, 0e0) AS score FROM k WHERE n <= 2")
def q162_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("sample", F.col("idx").alias("region_idx"), F.when(F.col("idx") % 3 != 0, F.col("idx") / 8).alias("score"))
    return select.low_confidence(rows, 2).select("sample", "region_idx", "score")


@query(f"{SCORES_SQL}, a AS (SELECT sample FROM scores_a ORDER BY teds, sample LIMIT 5), b AS (SELECT sample FROM scores_a ORDER BY teds_s, sample LIMIT 40), u AS (SELECT sample, 0 AS p FROM a UNION ALL SELECT sample, 1 FROM b), m AS (SELECT sample, min(p) AS p FROM u GROUP BY 1) SELECT sample FROM m ORDER BY p, sample LIMIT 12")
def q163_filled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir, "a")
    return select.filled_up([rows.orderBy("teds", "sample").limit(5).select("sample"), rows.orderBy("teds_s", "sample").limit(40).select("sample")], "sample", 12, [F.asc("sample")])


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) SELECT doc_id FROM r WHERE r <= 10")
def q164_sample_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.sample_by_hash(_docs(spark, sf_dir, "doc_id"), "doc_id", 10, without=table(spark, sf_dir, "labels"))


@query(f"{SCORES_SQL}, w AS (SELECT sample, teds, CASE WHEN sample % 3 > 0 THEN sample % 9 END AS rows FROM scores_a) SELECT sample FROM w WHERE teds BETWEEN 0.6 AND 0.8 AND coalesce(rows, 999) <= 6 ORDER BY abs(teds - 0.7), coalesce(rows, 999), sample LIMIT 12")
def q165_near_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("sample")
    return select.near_target(scores(spark, sf_dir, "a").withColumn("rows", F.when(k % 3 > 0, k % 9)), "teds", 0.7, 12, 0.6, 0.8, {"rows": 6}).select("sample")


@query("SELECT o_orderkey::BIGINT AS k FROM orders")
def q166_union_of_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    shards = [rows.where(F.col("k") % 4 == n).withColumn("shard", F.lit(n)) for n in range(4)]
    whole = shards[0].unionByName(shards[1]).unionByName(shards[2]).unionByName(shards[3])
    return sets.union_shards(whole, "shard", 4)


@query("SELECT o_orderkey::BIGINT AS k FROM orders")
def q167_disjoint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    return sets.union_disjoint([rows.where(F.col("k") % 2 == 0), rows.where(F.col("k") % 2 == 1)], "k")


@query("SELECT p_partkey::BIGINT AS k, CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS v FROM part")
def q168_updated_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("long").alias("k")
    part = lambda c, test: p.where(test).select(k, F.col(c).alias("v"))
    return sets.updated([part("p_name", "true"), part("p_type", "p_partkey % 2 = 0"), part("p_brand", "p_partkey % 4 = 0")], "k")


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def q169_union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_keys([_docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels")], "doc_id")


@query("WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'test' WHEN o_orderkey % 3 = 1 THEN 'train' ELSE 'validation' END AS split FROM orders), p AS (SELECT o_custkey, string_agg(DISTINCT split, '+' ORDER BY split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1) SELECT splits, count(*) AS keys FROM p GROUP BY 1")
def q170_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    return sets.leaks(table(spark, sf_dir, "orders").select("o_custkey", F.when(k == 0, "test").when(k == 1, "train").otherwise("validation").alias("split")), "o_custkey")


# Text


@query("SELECT p_partkey::BIGINT AS k, p_name AS normalised, lower(replace(p_name, ' ', '')) AS compacted, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '1b' AS keyed FROM part")
def q171_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), t.normalised(F.concat(F.lit(" "), F.replace(name, F.lit(" "), F.lit("  ­")), F.lit("\n"))).alias("normalised"), t.compacted(name).alias("compacted"), t.alignment_keyed(F.concat(name, F.lit(" １–B"))).alias("keyed"))


@query("SELECT p_partkey::BIGINT AS k, substr(replace(p_name, ' ', '?'), 1, 9) AS ascii, regexp_replace(p_name, ' +', '_', 'g') || '_x' AS file, CASE WHEN length(p_name) > 9 THEN substr(p_name, 1, 9) || '…' ELSE p_name END AS excerpt FROM part")
def q172_safe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), t.ascii_only(F.replace(name, F.lit(" "), F.lit("é")), 9).alias("ascii"), t.file_name_safe(F.concat(F.lit("/ "), name, F.lit("?x?"))).alias("file"), t.excerpt(name, 9).alias("excerpt"))


@query("SELECT p_partkey::BIGINT AS k, replace(p_name, ' ', '') AS rich, p_partkey::BIGINT AS number, printf('%.4f', p_size / 8e0) AS plain, printf('%+.4f', p_size / 8e0) AS signed, printf('%.1f', p_size * 12.5e0) || '%' AS percent FROM part")
def q173_numbers_and_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size") / 8
    number = t.numbered_text(F.concat(F.lit("step-"), key.cast("string"), F.lit(".bin")), "step-([0-9]+)")
    return table(spark, sf_dir, "part").select(key.cast("long").alias("k"), t.rich_text(F.split("p_name", " ")).alias("rich"), number.alias("number"), t.decimals(size).alias("plain"), t.signed_decimals(size).alias("signed"), t.percent(size).alias("percent"))


def _similar(name: str) -> Column:
    kernel = {"indel": t.indel_similarity, "ratio": t.ratio_similarity}[name]
    return t.kernel_column(lambda a, c: float(kernel(a, c)), F.col("a"), F.col("b"), kind="double").alias(name)


@query("WITH n AS (SELECT p_partkey::BIGINT AS k, length(p_name)::DOUBLE AS n FROM part), s AS (SELECT k, CASE k % 3 WHEN 0 THEN 2 * n / (2 * n + 3) WHEN 1 THEN 2 * (n - 3) / (2 * n) ELSE 2 * (n - 3) / (2 * n - 3) END AS v FROM n) SELECT k, v AS indel, v AS ratio FROM s")
def q174_sequence_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text against itself with three characters more in the middle, other ones there, or without the last three: the similarity follows from the lengths."""
    k, n = F.col("p_partkey"), F.length("p_name")
    half = F.floor(n / 2).cast("int")
    first, rest = F.substring(F.col("p_name"), F.lit(1), half), lambda more: F.substring(F.col("p_name"), half + 1 + more, n)
    other = F.when(k % 3 == 0, F.concat(first, F.lit("#@#"), rest(0))).when(k % 3 == 1, F.concat(first, F.lit("#@#"), rest(3))).otherwise(F.substring(F.col("p_name"), F.lit(1), n - 3))
    rows = table(spark, sf_dir, "part").select(k.cast("long").alias("k"), F.col("p_name").alias("a"), other.alias("b"))
    return rows.select("k", _similar("indel"), _similar("ratio"))


#: Words as single characters: their edit distance is that of texts. Multisets share, of each item, the smaller number.
_AGREEMENT = """WITH o AS (SELECT p_partkey::BIGINT AS k, lower(p_name) AS c, coalesce(lower(lead(p_name, 3) OVER (ORDER BY p_partkey)), 'end of list') AS r FROM part), w AS (SELECT k, c, r, string_split(c, ' ') AS cw, string_split(r, ' ') AS rw, replace(c, ' ', '') AS cd, replace(r, ' ', '') AS rd FROM o),
v AS (SELECT list(word ORDER BY word) AS words FROM (SELECT DISTINCT unnest(cw || rw) AS word FROM w)),
m AS (SELECT w.*, array_to_string(list_transform(cw, lambda x: chr((32 + list_position(words, x))::INT)), '') AS cs, array_to_string(list_transform(rw, lambda x: chr((32 + list_position(words, x))::INT)), '') AS rs FROM w, v),
b AS (SELECT *, list_sum(list_transform(list_distinct(cw), lambda x: least(len(list_filter(cw, lambda y: y = x)), len(list_filter(rw, lambda y: y = x)))))::DOUBLE AS both_words, list_sum(list_transform(list_distinct(string_split(cd, '')), lambda x: least(length(cd) - length(replace(cd, x, '')), length(rd) - length(replace(rd, x, '')))))::DOUBLE AS both_chars FROM m)"""


@query(f"""{_AGREEMENT} SELECT k, c = r AS exact, length(cd) / length(rd)::DOUBLE AS length_ratio, levenshtein(c, r) / length(r)::DOUBLE AS cer, 1 - levenshtein(c, r) / greatest(length(c), length(r))::DOUBLE AS char_similarity, 1 - levenshtein(cd, rd) / greatest(length(cd), length(rd))::DOUBLE AS compact_char_similarity, levenshtein(cs, rs) / len(rw)::DOUBLE AS wer,
  both_words / len(cw) AS token_precision, both_words / len(rw) AS token_recall, (len(rw) - both_words) / len(rw) AS missing_token_ratio, (len(cw) - both_words) / len(rw) AS extra_token_ratio, round(2 * both_words / (len(cw) + len(rw)), 12) AS token_f1, round(2 * both_chars / (length(cd) + length(rd)), 12) AS char_bag_f1 FROM b""")
def q175b_agreement_of_other_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against that of the third part after it."""
    ahead = sets.numbered(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_name"), ["k"])
    later = ahead.select((F.col("index") - 3).alias("index"), F.col("p_name").alias("later"))
    both = ahead.join(later, "index", "left").select("k", t.metrics_column(F.col("p_name"), F.coalesce("later", F.lit("end of list"))).alias("m")).select("k", "m.*")
    exact = ("exact", "length_ratio", "cer", "char_similarity", "compact_char_similarity", "wer", "token_precision", "token_recall", "missing_token_ratio", "extra_token_ratio")
    return both.select("k", *exact, F.round("token_f1", 12).alias("token_f1"), F.round("char_bag_f1", 12).alias("char_bag_f1"))


@query("""WITH a AS (SELECT p_partkey::BIGINT AS k, lower(p_name) AS c, lower(p_name || ' ' || p_brand) AS r FROM part)
SELECT k, false AS exact, length(replace(c, ' ', '')) / length(replace(r, ' ', ''))::DOUBLE AS length_ratio, (length(r) - length(c)) / length(r)::DOUBLE AS cer, 1 - (length(r) - length(c)) / length(r)::DOUBLE AS char_similarity, 1 / len(string_split(r, ' '))::DOUBLE AS missing_token_ratio, 0e0 AS extra_token_ratio,
  1e0 AS token_precision, len(string_split(c, ' ')) / len(string_split(r, ' '))::DOUBLE AS token_recall, 1 / len(string_split(r, ' '))::DOUBLE AS wer FROM a""")
def q175_text_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text against itself with one word more."""
    p = table(spark, sf_dir, "part")
    brand = F.regexp_replace("p_brand", " ", "")
    rows = p.select(F.col("p_partkey").cast("long").alias("k"), t.metrics_column(F.upper("p_name"), F.concat("p_name", F.lit(" "), brand)).alias("m"))
    return rows.select("k", *(f"m.{c}" for c in ("exact", "length_ratio", "cer", "char_similarity", "missing_token_ratio", "extra_token_ratio", "token_precision", "token_recall", "wer")))


# Geometry


@query(f"{BOXES_SQL} SELECT sample, idx, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM boxes WHERE idx % 3 < 2")
def q176_boxes_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corners in any order, polygons of four corners, and lists of other lengths, which are none."""
    v, i = {c: F.col(f"box.{c}").cast("double") for c in ("x0", "y0", "x1", "y1")}, F.col("idx") % 3
    numbers = F.when(i == 0, F.array(v["x1"], v["y1"], v["x0"], v["y0"])).when(i == 1, F.array(v["x0"], v["y0"], v["x1"], v["y0"], v["x1"], v["y1"], v["x0"], v["y1"])).otherwise(F.array(v["x0"], v["y0"]))
    return boxes(spark, sf_dir).select("sample", "idx", g.from_numbers(numbers).alias("b")).where("b IS NOT NULL").select("sample", "idx", "b.*")


@query(f"{BOXES_SQL}, i AS (SELECT sample, idx, greatest((x0 - 5) * 1.5e0, 0) AS a, greatest((50 - y1) * 1.5e0, 0) AS b, greatest((x1 - 5) * 1.5e0, 0) AS c, greatest((50 - y0) * 1.5e0, 0) AS d FROM boxes) SELECT sample, idx, trunc(a)::INT AS x0, trunc(b)::INT AS y0, trunc(c)::INT AS x1, trunc(d)::INT AS y1 FROM i")
def q177_page_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = g.box(F.lit(5), F.lit(0), F.lit(60), F.lit(50))
    return boxes(spark, sf_dir).select("sample", "idx", g.page_to_image(F.col("box"), page, 1.5).alias("b")).select("sample", "idx", "b.*")


@query(f"{BOXES_SQL}, c AS (SELECT sample, idx, least(greatest(x0 - 10, 0), 30) AS x0, least(greatest(y0 - 5, 0), 20) AS y0, least(greatest(x1 - 10, 0), 30) AS x1, least(greatest(y1 - 5, 0), 20) AS y1 FROM boxes) SELECT * FROM c WHERE x1 - x0 >= 1 AND y1 - y0 >= 1")
def q178_box_in_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = g.box(F.lit(10), F.lit(5), F.lit(40), F.lit(25))
    return boxes(spark, sf_dir).select("sample", "idx", g.to_crop(F.col("box"), crop).alias("b")).where("b IS NOT NULL").select("sample", "idx", "b.*")


@query(f"{BOXES_SQL}, f AS (SELECT sample, idx, least(greatest(x0 * 2e0, 0e0), 100e0) AS x0, least(greatest((40 - y1) * 2e0, 0e0), 80e0) AS fy0, least(greatest(x1 * 2e0, 0e0), 100e0) AS x1, least(greatest((40 - y0) * 2e0, 0e0), 80e0) AS fy1, least(greatest(y0 * 2e0, 0e0), 80e0) AS ny0, least(greatest(y1 * 2e0, 0e0), 80e0) AS ny1 FROM boxes) SELECT sample, idx, CASE WHEN x1 - x0 > 1 AND fy1 - fy0 > 1 THEN 'raw_flip' WHEN x1 - x0 > 1 AND ny1 - ny0 > 1 THEN 'raw_noflip' ELSE 'invalid' END AS mode FROM f")
def q179_scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = g.box(*(F.col(f"box.{c}").cast("double") for c in ("x0", "y0", "x1", "y1")))
    return boxes(spark, sf_dir).select("sample", "idx", reconstruct.scaled(d, 2.0, F.lit(50.0), F.lit(40.0)).alias("s")).select("sample", "idx", "s.mode")


#: Of boxes that are held inside bounds first: flipped or not, held, then as they are; whichever first has over a pixel.
_HELD = f"""{BOXES_SQL}, b AS (SELECT sample, idx, x0, y0, x1, y1, greatest(least(x0, 30), 12) AS hx0, greatest(least(x1, 30), 12) AS hx1, greatest(least(y0, 25), 8) AS hy0, greatest(least(y1, 25), 8) AS hy1 FROM boxes),
four AS (SELECT sample, idx, unnest([1, 2, 3, 4]) AS nth, unnest(['clamp_flip', 'clamp_noflip', 'raw_flip', 'raw_noflip']) AS mode, unnest([hx0, hx0, x0, x0]) * 2e0 AS a, unnest([40 - hy1, hy0, 40 - y1, y0]) * 2e0 AS b, unnest([hx1, hx1, x1, x1]) * 2e0 AS c, unnest([40 - hy0, hy1, 40 - y0, y1]) * 2e0 AS d FROM b),
cut AS (SELECT sample, idx, nth, mode, least(greatest(a, 0), 70e0) AS x0, least(greatest(b, 0), 80e0) AS y0, least(greatest(c, 0), 70e0) AS x1, least(greatest(d, 0), 80e0) AS y1 FROM four),
good AS (SELECT * FROM cut WHERE x1 - x0 > 1 AND y1 - y0 > 1 UNION ALL SELECT sample, idx, 5, 'invalid', x0, y0, x1, y1 FROM cut WHERE nth = 3)"""


@query(f"{_HELD} SELECT sample, idx, arg_min(mode, nth) AS mode, arg_min(x0, nth) AS x0, arg_min(y0, nth) AS y0, arg_min(x1, nth) AS x1, arg_min(y1, nth) AS y1 FROM good GROUP BY 1, 2")
def q179b_held_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes inside of, over and outside of the bounds, some of them off the page."""
    d = g.box(*(F.col(f"box.{c}").cast("double") for c in ("x0", "y0", "x1", "y1")))
    bounds = g.box(*(F.lit(float(v)) for v in (12, 8, 30, 25)))
    return boxes(spark, sf_dir).select("sample", "idx", reconstruct.scaled(d, 2.0, F.lit(35.0), F.lit(40.0), bounds).alias("s")).select("sample", "idx", "s.mode", "s.box.*")


@query(f"""{BOXES_SQL}, r AS (SELECT sample, idx, CASE idx % 3 WHEN 1 THEN 80 - y1 WHEN 2 THEN y0 ELSE x0 END AS a, CASE idx % 3 WHEN 1 THEN x0 WHEN 2 THEN 90 - x1 ELSE y0 END AS b, CASE idx % 3 WHEN 1 THEN 80 - y0 WHEN 2 THEN y1 ELSE x1 END AS c, CASE idx % 3 WHEN 1 THEN x1 WHEN 2 THEN 90 - x0 ELSE y1 END AS d FROM boxes)
SELECT sample, idx, least(greatest(a, 0), 80) AS x0, least(greatest(b, 0), 90) AS y0, least(greatest(c, 0), 80) AS x1, least(greatest(d, 0), 90) AS y1 FROM r""")
def q180_unrotated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.element_at(F.array(F.lit(0), F.lit(90), F.lit(270)), F.col("idx") % 3 + 1)
    return boxes(spark, sf_dir).select("sample", "idx", g.unrotate(F.col("box"), turn, F.lit(80), F.lit(90)).alias("b")).select("sample", "idx", "b.*")


@query(f"{BOXES_SQL} SELECT sample, idx, least(greatest(5 + x0 / 2e0 - 3e0, 0e0), 30e0) AS x0, least(greatest(2 + y0 / 2e0 - 3e0, 0e0), 25e0) AS y0, least(greatest(5 + x1 / 2e0 + 3e0, 0e0), 30e0) AS x1, least(greatest(2 + y1 / 2e0 + 3e0, 0e0), 25e0) AS y1 FROM boxes")
def q181_padded_page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop, page = g.box(F.lit(5.0), F.lit(2.0), F.lit(30.0), F.lit(25.0)), g.box(F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(25.0))
    return boxes(spark, sf_dir).select("sample", "idx", training.padded_page_box(F.col("box"), crop, page, 2.0, 3.0).alias("b")).select("sample", "idx", "b.*")


@query(f"{BOXES_SQL} SELECT sample, idx, round_even((x1 + y0) / nullif((x1 - x0) * (idx % 3), 0)::DOUBLE, 3) AS x, round_even((y1 + x0) / (y1 - y0)::DOUBLE, 3) AS y FROM boxes")
def q182_page_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of all kinds, some of a crop without a width (null)."""
    b = F.col("box")
    return boxes(spark, sf_dir).select("sample", "idx", training.page_fit((b["x1"] - b["x0"]) * (F.col("idx") % 3), b["y1"] - b["y0"], b["x1"] + b["y0"], b["y1"] + b["x0"]).alias("f")).select("sample", "idx", "f.*")


@query(f"{BOXES_SQL}, w AS (SELECT sample, idx, x0, x1, unnest(['ab', 'cdef', 'gh']) AS word, unnest([0, 1, 2]) AS k, unnest([0, 2, 6]) AS before, unnest([2, 6, 8]) AS upto FROM boxes) SELECT sample, idx, k::INT AS word_idx, word, x0 + (x1 - x0)::DOUBLE * before / 8e0 AS x0, CASE k WHEN 2 THEN x1::DOUBLE ELSE x0 + (x1 - x0)::DOUBLE * upto / 8e0 END AS x1 FROM w")
def q183_word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = reconstruct.word_boxes(boxes(spark, sf_dir).withColumn("text", F.lit(" ab cdef  gh ")))
    return words.select("sample", "idx", "word_idx", "word", F.col("box.x0").alias("x0"), F.col("box.x1").alias("x1"))


@query(f"{BOXES_SQL} SELECT sample, (idx // 4)::INT AS line, ((idx % 4) // 2)::INT AS region, string_agg(idx::VARCHAR, ' ' ORDER BY idx) AS text, (min(idx % 4) * 10 + min((idx % 4) // 2) * 50)::BIGINT AS x0 FROM boxes GROUP BY 1, 2, 3")
def q184_word_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on lines 40 pixels apart, in pairs with a wide gap between."""
    i = F.col("idx")
    x = (i % 4 * 10 + F.floor(i % 4 / 2) * 50).cast("long")
    y = F.floor(i / 4) * 40
    words = boxes(spark, sf_dir).select("sample", "idx", g.box(x, y, x + 8, y + 10).alias("box"), i.cast("string").alias("text"))
    return b.word_regions(words, 5, 4).select("sample", "line", "region", "text", F.col("box.x0").alias("x0"))


@query(f"{BOXES_SQL}, o AS (SELECT sample, idx, text, x0, y0, lag(y1) OVER w AS before FROM boxes WINDOW w AS (PARTITION BY sample ORDER BY y0, x0, idx)), l AS (SELECT *, sum(CASE WHEN before IS NULL OR y0 - before > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample ORDER BY y0, x0, idx ROWS UNBOUNDED PRECEDING) AS line FROM o) SELECT sample, line::BIGINT AS line, string_agg(text, ' ' ORDER BY x0, idx) AS text FROM l GROUP BY 1, 2")
def q185_grouped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.group_regions(boxes(spark, sf_dir), 1).select("sample", "line", "text")


@query(f"{BOXES_SQL} SELECT a.sample, a.idx, b.idx AS other, greatest(0, least(a.idx + 2, b.idx + 2) - greatest(a.idx, b.idx)) / (4e0 - greatest(0, least(a.idx + 2, b.idx + 2) - greatest(a.idx, b.idx))) AS iou FROM boxes a JOIN boxes b USING (sample)")
def q186_logical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical cells of two rows and one column each, as boxes of the grid."""
    rows = boxes(spark, sf_dir).select("sample", "idx", g.box(F.lit(0), F.col("idx"), F.lit(1), F.col("idx") + 2).alias("box"))
    return b.all_pairs(rows, rows).select("sample", "idx", "other", g.iou(F.col("box"), F.col("other_box")).alias("iou"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS i FROM orders) SELECT (i // 200)::BIGINT AS batch, count(*) AS n, min(o_orderkey)::BIGINT AS first FROM r GROUP BY 1")
def q188_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches over an order whose first column is a string of few values."""
    rows = sets.numbered(table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").cast("long").alias("k")), ["o_orderpriority", "k"])
    return rows.groupBy(sets.batch_of(F.col("index"), 200).alias("batch")).agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query(f"{BOXES_SQL}, v AS (SELECT sample, idx, CASE WHEN sample % 2 = 0 AND idx % 3 <> 1 THEN idx * 50 END AS v FROM boxes) SELECT sample, idx, CASE WHEN sample % 2 = 1 THEN idx * 7e0 WHEN v IS NULL AND idx = max(idx) OVER (PARTITION BY sample) THEN (idx - 1) * 50e0 ELSE idx * 50e0 END AS filled FROM v")
def q189_interpolated_or_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values on a line; nothing known in every other group, which takes the even steps."""
    i = F.col("idx")
    rows = boxes(spark, sf_dir).select("sample", "idx", F.when((F.col("sample") % 2 == 0) & (i % 3 != 1), i * 50).alias("v"))
    return b.interpolated(rows, "sample", "idx", "v", even=(i * 7).cast("double")).select("sample", "idx", "filled")
