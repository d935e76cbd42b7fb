"""Queries with table functions: tables whose cells span rows and columns, by lateral joins, beside a walk over the grid in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import table_functions
from .registry import query
from .relations import ORDER, table

#: Three cells a line item: how many rows and columns each spans, and its text.
_CELLS = f"""items AS (SELECT l_orderkey AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS r, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q FROM lineitem),
three AS (SELECT sample, r, 0 AS j, 1 + (p % 3 = 0)::INT AS high, 1 + (s % 4 = 0)::INT AS wide, p::VARCHAR AS text FROM items
  UNION ALL SELECT sample, r, 1, 1, 1 + (p % 5 = 0)::INT, s::VARCHAR FROM items UNION ALL SELECT sample, r, 2, 1 + (q % 5) // 2, 1, q::VARCHAR FROM items),
cells AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY r, j) - 1 AS k, count(*) OVER (PARTITION BY sample) AS n FROM three)"""

#: Cell after cell takes the first column, from where the row is, that no cell above reaches into; taken: the first free row of each column.
_WALK = """walk AS (
  SELECT sample, -1::BIGINT AS k, -1::BIGINT AS r, 0::BIGINT AS at, 0::BIGINT AS c0, 0::BIGINT AS wide, 0::BIGINT AS high, []::BIGINT[] AS taken, NULL::VARCHAR AS text FROM (SELECT DISTINCT sample FROM cells)
  UNION ALL
  SELECT sample, k, r, c0 + wide, c0, wide, high, list_transform(range(0, greatest(len(taken), c0 + wide)), lambda c: CASE WHEN c >= c0 AND c < c0 + wide THEN greatest(coalesce(taken[c + 1], 0), r + high) ELSE taken[c + 1] END), text
  FROM (SELECT w.sample, c.k, c.r, c.wide, c.high, c.text, w.taken, list_filter(range(CASE WHEN c.r = w.r THEN w.at ELSE 0 END, CASE WHEN c.r = w.r THEN w.at ELSE 0 END + len(w.taken) + 1), lambda x: coalesce(w.taken[x + 1], 0) <= c.r)[1] AS c0
    FROM walk w JOIN cells c ON c.sample = w.sample AND c.k = w.k + 1))"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, r and cells (array of high, wide, text) of each line item."""
    li = table(spark, sf_dir, "lineitem")
    r = (F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)) - 1).cast("int")
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    one = lambda high, wide, text: F.struct(high.cast("int").alias("high"), wide.cast("int").alias("wide"), text.cast("string").alias("text"))
    yes = lambda x: x.cast("int") + 1
    cells = F.array(one(yes(p % 3 == 0), yes(s % 4 == 0), p), one(F.lit(1), yes(p % 5 == 0), s), one(F.floor(q % 5 / 2) + 1, F.lit(1), q))
    return li.select(F.col("l_orderkey").alias("sample"), r.alias("r"), cells.alias("cells"))


def _by_sample(rows: DataFrame, line: F.Column, name: str) -> DataFrame:
    """sample and the lines of its rows, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("sample").agg(lines.alias(name))


def _attribute(name: str, n: F.Column) -> F.Column:
    return F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise(F.lit(""))


@query(f"""WITH RECURSIVE {_CELLS}, {_WALK}
SELECT sample, k::INT AS cell_idx, r::INT AS r0, (r + high)::INT AS r1, c0::INT AS c0, (c0 + wide)::INT AS c1, text FROM walk WHERE k >= 0""")
def q71b_cells_with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup whose cells span rows and columns."""
    cell = lambda c: F.concat(F.lit("<td"), _attribute("rowspan", c["high"]), _attribute("colspan", c["wide"]), F.lit(">"), c["text"], F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", cell), ""), F.lit("</tr>"))
    tables = _by_sample(_items(spark, sf_dir), line, "lines").select("sample", F.concat(F.lit("<table>"), F.array_join("lines", ""), F.lit("</table>")).alias("markup"))
    tables.createOrReplaceTempView("tables_with_spans")
    table_functions.register(spark)
    return spark.sql("SELECT t.sample, c.cell_idx, c.r0, c.r1, c.c0, c.c1, c.text FROM tables_with_spans t, LATERAL cells_of_markup(t.markup) c")


@query(f"""WITH RECURSIVE {_CELLS}, {_WALK}
SELECT w.sample, w.k::INT AS cell_idx, w.r::INT AS r0, (w.r + w.high)::INT AS r1, w.c0::INT AS c0, (w.c0 + w.wide)::INT AS c1 FROM walk w JOIN (SELECT DISTINCT sample, n FROM cells) USING (sample) WHERE k >= 0 AND k < n - sample % 3""")
def q73b_token_cells_with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure tokens, start tags in parts, of tables of which some lack the contents of their last cells."""
    cell = lambda c: F.array_compact(F.array(F.when((c["high"] == 1) & (c["wide"] == 1), F.lit("<td>")).otherwise(F.lit("<td")), F.nullif(_attribute("rowspan", c["high"]), F.lit("")), F.nullif(_attribute("colspan", c["wide"]), F.lit("")), F.when((c["high"] > 1) | (c["wide"] > 1), F.lit(">")), F.lit("</td>")))
    line = F.concat(F.array(F.lit("<tr>")), F.flatten(F.transform("cells", cell)), F.array(F.lit("</tr>")))
    rows = _by_sample(_items(spark, sf_dir), line, "lines").select("sample", F.flatten("lines").alias("tokens"), (F.size("lines") * 3 - F.col("sample") % 3).cast("int").alias("contents"))
    found = rows.lateralJoin(table_functions.cells_of_tokens(F.col("tokens").outer(), F.col("contents").outer()))
    return found.select("sample", "cell_idx", "r0", "r1", "c0", "c1")


_OTSL = f"""items AS (SELECT l_orderkey AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS r, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q FROM lineitem),
given AS (SELECT sample, r, 0 AS c, CASE WHEN p % 4 = 0 THEN 'ucel' ELSE 'fcel' END AS t FROM items
  UNION ALL SELECT sample, r, 1, CASE p % 3 WHEN 0 THEN 'lcel' WHEN 1 THEN 'ecel' ELSE 'rhed' END FROM items
  UNION ALL SELECT sample, r, 2, CASE s % 4 WHEN 0 THEN 'ucel' WHEN 1 THEN 'xcel' WHEN 2 THEN 'lcel' ELSE 'ched' END FROM items WHERE q % 5 <> 0),
sizes AS (SELECT sample, max(r) + 1 AS high, max(c) + 1 AS wide FROM given GROUP BY sample),
grid AS (SELECT sample, high, wide, r, unnest(range(0, wide)) AS c FROM (SELECT *, unnest(range(0, high)) AS r FROM sizes)),
places AS (SELECT sample, r, c, high, wide, coalesce(t, 'ecel') AS t FROM grid LEFT JOIN given USING (sample, r, c)),
"""


@query(f"""WITH {_OTSL}
ends AS (SELECT a.*, coalesce((SELECT min(b.c) FROM places b WHERE b.sample = a.sample AND b.r = a.r AND b.c > a.c AND b.t <> 'lcel'), wide) AS c1, coalesce((SELECT min(b.r) FROM places b WHERE b.sample = a.sample AND b.c = a.c AND b.r > a.r AND b.t <> 'ucel'), high) AS r1
  FROM places a WHERE t IN ('fcel', 'ecel', 'ched', 'rhed', 'srow'))
SELECT sample, (row_number() OVER (PARTITION BY sample ORDER BY r, c) - 1)::INT AS cell_idx, r::INT AS r0, r1::INT AS r1, c::INT AS c0, c1::INT AS c1, t IN ('ched', 'rhed') AS header FROM ends""")
def q80b_otsl_with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTSL whose cells go on to the right and downwards, with short rows."""
    li = _items(spark, sf_dir)
    p, s, q = (F.col("cells")[k]["text"].cast("long") for k in range(3))
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    third = F.when(q % 5 != 0, F.array(pick(s % 4, "ucel", "xcel", "lcel", "ched"))).otherwise(F.array().cast("array<string>"))
    line = F.concat(F.array(F.when(p % 4 == 0, F.lit("ucel")).otherwise(F.lit("fcel")), pick(p % 3, "lcel", "ecel", "rhed")), third, F.array(F.lit("nl")))
    rows = _by_sample(li, line, "lines").select("sample", F.flatten("lines").alias("tokens"))
    return rows.lateralJoin(table_functions.cells_of_otsl(F.col("tokens").outer())).select("sample", "cell_idx", "r0", "r1", "c0", "c1", "header")
