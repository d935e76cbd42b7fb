"""Relations of the engine's shapes derived from the generic tables by whole-number arithmetic: equal in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Multipliers of order and customer keys that make the two runs' scores in thousandths: teds_s, then teds, which is no higher.
RUNS = {"a": (11, 37, 7, 13), "b": (17, 29, 5, 19)}


def scores(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    """sample, cls, document, teds_s, teds of a run, one row for each order."""
    p, q, r, s = RUNS[run]
    o = table(spark, sf_dir, "orders")
    first = F.pmod(F.col("o_orderkey") * p + F.col("o_custkey") * q, F.lit(1001))
    second = F.pmod(F.col("o_orderkey") * r + F.col("o_custkey") * s, F.lit(1001))
    return o.select(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("cls"), F.col("o_custkey").alias("document"), (first / F.lit(1000e0)).alias("teds_s"), (F.least(first, second) / F.lit(1000e0)).alias("teds"))


def _scores_sql(run: str) -> str:
    p, q, r, s = RUNS[run]
    return f"""scores_{run} AS (SELECT o_orderkey AS sample, o_orderpriority AS cls, o_custkey AS document,
  ((o_orderkey*{p}+o_custkey*{q})%1001)/1000e0 AS teds_s, least((o_orderkey*{p}+o_custkey*{q})%1001, (o_orderkey*{r}+o_custkey*{s})%1001)/1000e0 AS teds FROM orders)"""


SCORES_SQL = f"WITH {_scores_sql('a')}, {_scores_sql('b')}"
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, idx and box of each line item, whole numbers."""
    li = table(spark, sf_dir, "lineitem")
    idx = (F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)) - 1).cast("int")
    x0, y0 = F.pmod("l_partkey", F.lit(50)), F.pmod("l_suppkey", F.lit(40))
    x1, y1 = x0 + 5 + F.pmod(F.col("l_quantity").cast("long"), F.lit(20)), y0 + 4 + F.col("l_linenumber") * 3
    return li.select(F.col("l_orderkey").alias("sample"), idx.alias("idx"), g.box(x0, y0, x1, y1).alias("box"), F.col("l_returnflag").alias("text"))


def shifted(rows: DataFrame) -> DataFrame:
    """The boxes moved and grown a little, by their place."""
    b, i = F.col("box"), F.col("idx")
    return rows.withColumn("box", g.box(b["x0"] + i % 3, b["y0"] + i % 2, b["x1"] + i % 4, b["y1"] + i % 3))


BOXES_SQL = f"""WITH boxes AS (SELECT l_orderkey AS sample, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1)::INT AS idx,
  l_partkey%50 AS x0, l_suppkey%40 AS y0, l_partkey%50 + 5 + l_quantity::BIGINT%20 AS x1, l_suppkey%40 + 4 + l_linenumber*3 AS y1, l_returnflag AS text FROM lineitem),
shifted AS (SELECT sample, idx, x0+idx%3 AS x0, y0+idx%2 AS y0, x1+idx%4 AS x1, y1+idx%3 AS y1, text FROM boxes),
pairs AS (SELECT a.sample, a.idx, b.idx AS other, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS both_,
  (a.x1-a.x0)*(a.y1-a.y0) AS area_a, (b.x1-b.x0)*(b.y1-b.y0) AS area_b
  FROM boxes a JOIN shifted b ON a.sample=b.sample AND a.x0<b.x1 AND b.x0<a.x1 AND a.y0<b.y1 AND b.y0<a.y1)"""


def tables(spark: SparkSession, sf_dir: str, edit: bool = False) -> DataFrame:
    """sample and markup: a table of each order's line items, a row for each; the edited ones drop a cell, a row or a letter here and there."""
    li = table(spark, sf_dir, "lineitem")
    idx = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)) - 1
    flag = F.when(F.lit(edit) & (F.pmod("l_partkey", F.lit(5)) == 0), F.concat("l_returnflag", F.lit("x"))).otherwise(F.col("l_returnflag"))
    last = F.when(F.lit(edit) & (F.pmod("l_suppkey", F.lit(7)) == 0), F.lit("")).otherwise(F.concat(F.lit("<td>"), F.col("l_linestatus"), F.lit("</td>")))
    row = F.concat(F.lit("<tr><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), flag, F.lit("</td>"), last, F.lit("</tr>"))
    rows = li.select(F.col("l_orderkey").alias("sample"), idx.alias("idx"), row.alias("row"), F.pmod("l_partkey", F.lit(11)).alias("k"))
    rows = rows.where("k <> 0 OR idx = 0") if edit else rows
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "row"))), lambda s: s["row"]), "")
    return rows.groupBy("sample").agg(F.concat(F.lit("<table>"), lines, F.lit("</table>")).alias("markup"))


TABLES_SQL = f"""WITH items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS idx FROM lineitem),
tables AS (SELECT l_orderkey AS sample, '<table>' || string_agg('<tr><td>' || l_partkey || '</td><td>' || l_returnflag || '</td><td>' || l_linestatus || '</td></tr>', '' ORDER BY idx) || '</table>' AS markup FROM items GROUP BY l_orderkey)"""
