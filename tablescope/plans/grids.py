"""Queries over markup, tokens and grids: tables without spans, whose parts SQL can name, taken through the kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import diffs, markup, structure
from ..functions import geometry as g
from ..functions.text import kernel_column
from ..operators import boxes as b
from ..operators import scores as s
from ..operators import reconstruct, tables, tracks
from .registry import query
from .relations import BOXES_SQL, ORDER, TABLES_SQL, boxes, table
from .relations import tables as markup_tables

ROW = "'<tr><td>' || l_partkey || '</td><td>' || l_returnflag || '</td><td>' || l_linestatus || '</td></tr>'"
#: All rows but the first, and the first, of a table.
PARTS = f"parts AS (SELECT l_orderkey AS sample, count(*) AS n, string_agg({ROW}, '' ORDER BY idx) AS rows, max(CASE WHEN idx = 0 THEN {ROW} END) AS head, coalesce(string_agg({ROW}, '' ORDER BY idx) FILTER (idx > 0), '') AS rest FROM items GROUP BY 1)"
CELLS = "cells AS (SELECT l_orderkey AS sample, idx, unnest([0, 1, 2]) AS c, unnest([l_partkey::VARCHAR, l_returnflag, l_linestatus]) AS text FROM items)"


def _html(f, *columns: Column, kind: str = "string") -> Column:  # noqa: ANN001
    return kernel_column(f, *(columns or (F.col("markup"),)), kind=kind)


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables with their first rows in a head and the others in a body."""
    return markup_tables(spark, sf_dir).withColumn("markup", F.regexp_replace("markup", "^<table>(<tr>.*?</tr>)(.*)</table>$", "<table><thead>$1</thead><tbody>$2</tbody></table>"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, n, and the texts of the cells in order."""
    # a table is in one row as it is: no shuffle brings its cells together
    return tables.cell_lists(markup_tables(spark, sf_dir))


def _tokens(row: list[str], n: Column) -> Column:
    return F.flatten(F.array_repeat(F.array(*map(F.lit, row)), n))


PLAIN_ROW = ["<tr>", *["<td>", "</td>"] * 3, "</tr>"]


@query(f"{TABLES_SQL} SELECT sample, '<html><body>' || markup || '</body></html>' AS document FROM tables")
def q65_as_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_tables(spark, sf_dir).select("sample", _html(markup.as_document, F.concat(F.lit('<?xml version="1.0"?> '), "markup")).alias("document"))


@query(f"{TABLES_SQL} SELECT sample, '<html><body>' || markup || '</body></html>' AS document FROM tables")
def q66_first_table_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = F.concat(F.lit("<p>before</p><!-- a comment -->"), F.replace("markup", F.lit("</tr>"), F.lit("</tr><!-- c -->")), F.lit("<table><tr><td>second</td></tr></table>"))
    return markup_tables(spark, sf_dir).select("sample", _html(markup.comment_free_document, around).alias("document"))


@query(f"{TABLES_SQL} SELECT sample, markup FROM tables")
def q67_flattened_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sectioned(spark, sf_dir).select("sample", _html(lambda m: markup.under_policy(m, "flattened")).alias("markup"))


@query(f"{TABLES_SQL} SELECT sample, markup FROM tables")
def q68_canonical_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = F.regexp_replace(F.regexp_replace("markup", "<td>([^<]*)</td>", '<th style="x"><span> $1 <br></span><!-- c --></th>'), "<table>", '<table class="y">')
    return markup_tables(spark, sf_dir).select("sample", _html(lambda m: markup.under_policy(m, "canonical"), rich).alias("markup"))


@query(f"{TABLES_SQL}, {PARTS} SELECT sample, '<table><thead>' || head || '</thead>' || CASE WHEN rest = '' THEN '' ELSE '<tbody>' || rest || '</tbody>' END || '</table>' AS markup FROM parts")
def q69_wrapped_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = F.regexp_replace("markup", "</?tbody>", "")
    return _sectioned(spark, sf_dir).select("sample", _html(lambda m: markup.under_policy(m, "wrapped"), loose).alias("markup"))


@query(f"{TABLES_SQL}, s AS (SELECT sample, replace(replace(replace(replace(markup, '<td>N<', '<td><b>N</b><'), '<td>R<', '<td><b>R</b><'), '<table>', ''), '</table>', '') AS rows FROM tables) SELECT sample, '<table><thead>' || rows || '</thead><tbody></tbody></table>' AS markup FROM s")
def q70_stripped_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    blanks = F.regexp_replace(F.regexp_replace("markup", "<td>([NR])</td>", "<td><b> $1 </b></td>"), "<td>([^<]+)</td>", "<td> $1  </td>")
    return markup_tables(spark, sf_dir).select("sample", _html(lambda m: markup.under_policy(m, "stripped"), blanks).alias("markup"))


@query(f"""{TABLES_SQL}, {PARTS} SELECT sample, CASE sample % 4 WHEN 3 THEN NULL ELSE '<table><thead>' || CASE sample % 4 WHEN 2 THEN '' ELSE head END || '</thead><tbody>' || rest || '</tbody></table>' END AS markup FROM parts""")
def q70b_reassembled_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and bodies with blanks in their cells: as they should be, without the tags around the body, with an empty head, and with text in no cell, which is an error (null)."""
    k = F.col("sample") % 4
    broken = F.when(k == 1, F.regexp_replace("markup", "</?tbody>", "")).when(k == 2, F.regexp_replace("markup", "<thead>.*</thead>", "<thead></thead>")).when(k == 3, F.replace("markup", F.lit("</thead>"), F.lit("loose</thead>"))).otherwise(F.col("markup"))
    blanks = F.regexp_replace(broken, "<td>([^<]+)</td>", "<td>\t $1  </td>")

    def found(text: str) -> str | None:
        try:
            return markup.under_policy(text, "stripped")
        except ValueError:
            return None

    return _sectioned(spark, sf_dir).select("sample", _html(found, blanks).alias("markup"))


@query(f"{TABLES_SQL}, {CELLS} SELECT sample, (idx * 3 + c)::INT AS cell_idx, idx::INT AS r0, c::INT AS c0, text, (idx = 0) AS header FROM cells")
def q71_cells_of_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.logical_cells(_sectioned(spark, sf_dir)).select("sample", "cell_idx", "r0", "c0", "text", "header")


@query(f"{TABLES_SQL} SELECT l_orderkey AS sample, count(*)::INT + 1 AS rows FROM items GROUP BY 1")
def q72_nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in a cell of each table: with all descendant rows, its row counts too."""
    nested = F.regexp_replace("markup", "</td></tr></table>$", "<table><tr><td>x</td></tr></table></td></tr></table>")
    cells = tables.logical_cells(markup_tables(spark, sf_dir).withColumn("markup", nested), nested=True)
    return cells.groupBy("sample").agg(F.max("r1").alias("rows"))


@query(f"""{TABLES_SQL}, {CELLS}, n AS (SELECT sample, max(idx) + 1 AS n FROM cells GROUP BY 1)
SELECT sample, (idx * 3 + c)::INT AS cell_idx, idx::INT AS r0, (idx + 1)::INT AS r1, c::INT AS c0, (c + 1)::INT AS c1, text, (c * 10)::DOUBLE AS x0 FROM cells JOIN n USING (sample) WHERE idx * 3 + c < n * 3 - 1""")
def q73_annotation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure tokens with contents, the last of which is missing."""
    contents = F.transform(F.slice("texts", 1, F.size("texts") - 1), lambda t, i: F.struct(F.split(t, "").alias("tokens"), F.array(*((i % 3 * 10 + d).cast("double") for d in (0, 1, 5, 6))).alias("bbox")))
    rows = _lists(spark, sf_dir).select("sample", _tokens(PLAIN_ROW, F.col("n")).alias("tokens"), contents.alias("cells"))
    return tables.annotation_cells(rows).select("sample", "cell_idx", "r0", "r1", "c0", "c1", "text", F.col("box.x0").alias("x0"))


@query(f"""{TABLES_SQL}, {CELLS} SELECT sample, (idx * 3 + c + 1)::INT AS id, text, (idx * 3 + c)::INT AS line, 0::INT AS index_in_line, (c * 10)::DOUBLE AS x0 FROM cells""")
def q74_recognised_cell_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.recognised_tokens(_boxed_cells(spark, sf_dir)).select("sample", "id", "text", "line", "index_in_line", F.col("box.x0").alias("x0"))


def _boxed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("c0") * 10).cast("double")
    box = F.struct(x.alias("x0"), F.lit(0.0).alias("y0"), (x + 8).alias("x1"), F.lit(5.0).alias("y1"))
    return tables.logical_cells(markup_tables(spark, sf_dir)).withColumn("box", box)


@query(f"""{TABLES_SQL}, {CELLS}, w AS (SELECT sample, idx * 3 + c AS line, c, unnest(['ab', text]) AS text, unnest([0, 1]) AS k, length(text) AS n FROM cells)
SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY line, k)::INT AS id, text, line::INT AS line, k::INT AS index_in_line, CASE k WHEN 0 THEN c * 10e0 ELSE c * 10e0 + 8e0 * 2e0 / (n + 2e0) END AS x0 FROM w""")
def q75_recognised_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _boxed_cells(spark, sf_dir).withColumn("text", F.concat(F.lit("ab "), "text"))
    return tables.recognised_tokens(cells, words=True).select("sample", "id", "text", "line", "index_in_line", F.col("box.x0").alias("x0"))


@query(f"{TABLES_SQL} SELECT l_orderkey AS sample, count(*)::INT AS rows, 4::INT AS columns FROM items GROUP BY 1")
def q76_token_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = ['<tr class="x">', "<td", ' colspan="2"', ">", "</td>", *["<td>", "</td>"] * 2, "</tr>"]
    rows = _lists(spark, sf_dir).select("sample", _html(lambda t: dict(zip(("rows", "columns"), markup.table_shape(list(t)), strict=True)), _tokens(row, F.col("n")), kind="struct<rows: int, columns: int>").alias("s"))
    return rows.select("sample", "s.*")


@query(f"{TABLES_SQL}, {PARTS} SELECT sample, rows FROM parts")
def q77_filled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("sample", _html(lambda t, x: markup.fill_tokens(list(t), list(x)), _tokens(PLAIN_ROW, F.col("n")), F.col("texts")).alias("rows"))


@query(f"{TABLES_SQL}, {PARTS} SELECT sample, '<table><thead>' || head || '</thead><tbody>' || rest || '</tbody></table>' AS markup FROM parts")
def q78_cells_to_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sectioned(spark, sf_dir).select("sample", _html(lambda m: markup.cells_markup(markup.logical_cells(m))).alias("markup"))


@query(f"{TABLES_SQL}, {PARTS} SELECT sample, rows AS in_order, '<table>' || rows || '</table>' AS by_place FROM parts")
def q79_injected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).withColumn("tokens", _tokens(PLAIN_ROW, F.col("n")))
    in_order = _html(lambda t, x: structure.texts_in_order(list(t), list(x)), F.col("tokens"), F.col("texts"))
    by_place = _html(lambda t, x: structure.placed_text(list(t), {(k // 3, k % 3): v for k, v in enumerate(x)}), F.col("tokens"), F.col("texts"))
    return rows.select("sample", in_order.alias("in_order"), by_place.alias("by_place"))


@query(f"""{TABLES_SQL}, c AS (SELECT l_orderkey AS sample, idx, unnest([0, 2]) AS c0, unnest([2, 3]) AS c1 FROM items) SELECT sample, idx::INT AS r0, (idx + 1)::INT AS r1, c0::INT AS c0, c1::INT AS c1 FROM c""")
def q80_otsl_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _html(lambda t: [{"r0": c.r0, "r1": c.r1, "c0": c.c0, "c1": c.c1} for c in markup.otsl_cells(list(t))], _tokens(["fcel", "lcel", "fcel", "nl", "nl"], F.col("n")), kind="array<struct<r0: int, r1: int, c0: int, c1: int>>")
    return _lists(spark, sf_dir).select("sample", F.inline(found))


@query(f"""{TABLES_SQL} SELECT l_orderkey AS sample, string_agg('<tr><td colspan="2">' || l_partkey || '</td><td>' || l_linestatus || '</td></tr>', '' ORDER BY idx) AS rows FROM items GROUP BY 1""")
def q81_otsl_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.filter("texts", lambda _, i: i % 3 != 1)
    return _lists(spark, sf_dir).select("sample", _html(lambda t, x: structure.otsl_markup(list(t), list(x)), _tokens(["fcel", "lcel", "fcel", "nl"], F.col("n")), two).alias("rows"))


@query(f"""{TABLES_SQL}, n AS (SELECT l_orderkey AS sample, count(*) AS n, string_agg('<tr><td colspan="2">' || l_partkey || '</td><td>' || l_linestatus || '</td></tr>', '' ORDER BY idx) AS rows FROM items GROUP BY 1)
SELECT sample, CASE sample % 3 WHEN 0 THEN rows END AS rows, CASE sample % 3 WHEN 1 THEN 'row ' || (n - 1) || ': 1 texts for 2 cells' WHEN 2 THEN (n + 1) || ' rows of texts for ' || n || ' rows' END AS error FROM n""")
def q81b_otsl_markup_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by row: as many as there are cells, one too few in the last row, or one row too many."""
    k, n = F.col("sample") % 3, F.col("n")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.when((k == 1) & (r == n - 1), F.slice("texts", r * 3 + 1, 1)).otherwise(F.array(F.get("texts", r * 3), F.get("texts", r * 3 + 2))))
    rows = F.when(k == 2, F.concat(rows, F.array(F.array(F.lit("more"))))).otherwise(rows)

    def found(tokens: list, given: list) -> dict:
        try:
            return {"rows": structure.otsl_markup_by_row(list(tokens), [list(r) for r in given]), "error": None}
        except ValueError as why:
            return {"rows": None, "error": str(why)}

    made = _html(found, _tokens(["fcel", "lcel", "fcel", "nl"], n), rows, kind="struct<rows: string, error: string>")
    return _lists(spark, sf_dir).withColumn("n", n.cast("int")).select("sample", made.alias("m")).select("sample", "m.*")


@query(f"""{TABLES_SQL} SELECT l_orderkey AS sample, '<thead><tr><td></td><td></td><td></td></tr></thead><tbody>' || repeat('<tr><td></td><td></td><td></td></tr>', count(*) - 1) || '</tbody>' AS tokens, string_agg(l_partkey || ',' || l_returnflag || ',' || l_linestatus, ',' ORDER BY idx) AS texts FROM items GROUP BY 1""")
def q82_structure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _html(lambda m: dict(zip(("tokens", "texts"), ("".join(markup.structure(m)[0]), ",".join(markup.structure(m)[1])), strict=True)), kind="struct<tokens: string, texts: string>")
    return _sectioned(spark, sf_dir).select("sample", found.alias("f")).select("sample", "f.*")


@query(f"""{TABLES_SQL} SELECT l_orderkey AS sample, 'ched ched ched nl' || repeat(' fcel fcel fcel nl', count(*) - 1) AS tokens FROM items GROUP BY 1""")
def q83_otsl_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sectioned(spark, sf_dir).select("sample", _html(lambda m: " ".join(markup.otsl_tokens(markup.logical_cells(m)))).alias("tokens"))


_TOKEN_ROW = "<tr><td></td><td></td><td></td></tr>"


@query(f"""{TABLES_SQL} SELECT l_orderkey AS sample, '<thead></thead><tbody>' || repeat('{_TOKEN_ROW}', count(*)) || '</tbody>' AS empty_head, '<thead>{_TOKEN_ROW}</thead><tbody>' || repeat('{_TOKEN_ROW}', count(*) - 1) || '</tbody>' AS first_row FROM items GROUP BY 1""")
def q84_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).withColumn("tokens", F.concat(F.array(F.lit("<table>")), _tokens(PLAIN_ROW, F.col("n")), F.array(F.lit("</table>"))))
    made = lambda head: _html(lambda t: "".join(structure.sectioned(list(t), head)), F.col("tokens"))
    return rows.select("sample", made(False).alias("empty_head"), made(True).alias("first_row"))


@query(f"""{TABLES_SQL} SELECT l_orderkey AS sample, count(*)::INT AS rows, (count(*) * 3)::INT AS cells, 0::INT AS rowspan_cells, count(*)::INT AS colspan_cells, count(*)::INT AS span_cells, count(*)::BIGINT AS b, 0::BIGINT AS i, 0::BIGINT AS sup, 0::BIGINT AS sub, count(*)::BIGINT AS style,
  count(*)::BIGINT AS colspan, 1::BIGINT AS thead_tr, (count(*) - 1)::BIGINT AS tbody_tr FROM items GROUP BY 1""")
def q85_table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = F.regexp_replace("markup", "<tr><td>([^<]*)</td>", '<tr><td colspan="2" style="x"><b>$1</b></td>')
    rows = _sectioned(spark, sf_dir).withColumn("markup", rich)
    tree = _html(markup.tree_statistics, kind="struct<rows: int, cells: int, rowspan_cells: int, colspan_cells: int, span_cells: int>")
    found = rows.select("sample", tree.alias("t"), tables.inline_statistics(F.col("markup")).alias("i"), tables.markup_statistics(F.col("markup")).alias("m"))
    return found.select("sample", "t.*", "i.*", "m.colspan", "m.thead_tr", "m.tbody_tr")


@query(f"{TABLES_SQL} SELECT l_orderkey AS sample, CASE WHEN l_orderkey % 2 = 0 THEN 'complex' ELSE 'simple' END AS by_spans, 'complex' AS by_sections FROM items GROUP BY 1")
def q86_table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("sample") % 2 == 0, F.regexp_replace("markup", "<thead><tr><td>", '<thead><tr><td rowspan="2">')).otherwise(F.col("markup"))
    return _sectioned(spark, sf_dir).select("sample", _html(structure.type_by_spans, some).alias("by_spans"), _html(structure.type_by_sections).alias("by_sections"))


_EXTRA = "<tr><td>zzz</td></tr></table>"


@query(f"{TABLES_SQL} SELECT sample, 'insert' AS kind, '' AS before, '<tr> <td> zzz </td> </tr>' AS after FROM tables")
def q87_token_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.replace("markup", F.lit("</table>"), F.lit(_EXTRA))
    found = _html(lambda a, c: [dict(zip(("kind", "before", "after"), o, strict=True)) for o in diffs.operations(a, c)], F.col("markup"), more, kind="array<struct<kind: string, before: string, after: string>>")
    return markup_tables(spark, sf_dir).select("sample", F.inline(found))


@query(f"{TABLES_SQL} SELECT l_orderkey AS sample, 3::INT AS added, 0::INT AS removed, (count(*) * 5 + 2)::INT AS lines FROM items GROUP BY 1")
def q88_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.replace("markup", F.lit("</table>"), F.lit(_EXTRA))
    found = _html(diffs.changed_lines, F.col("markup"), more, kind="array<string>")
    count = lambda mark: F.size(F.filter("d", lambda x: x.startswith(mark) & ~x.startswith(mark * 3)))
    rows = markup_tables(spark, sf_dir).select("sample", found.alias("d"), F.size(_html(diffs.tag_lines, kind="array<string>")).alias("lines"))
    return rows.select("sample", count("+").alias("added"), count("-").alias("removed"), "lines")


@query(f"""{TABLES_SQL}, r AS (SELECT l_orderkey AS sample, idx, count(*) OVER (PARTITION BY l_orderkey) AS n, {ROW} AS row FROM items) SELECT sample, string_agg(row, '' ORDER BY idx) AS rows FROM r WHERE idx < 1 OR idx >= n - 2 GROUP BY 1""")
def q89_row_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_tables(spark, sf_dir).select("sample", _html(lambda m: "".join(diffs.outer_rows(m, 3))).alias("rows"))


@query(f"""{TABLES_SQL}, {CELLS} SELECT sample, text, CASE WHEN length(text) > 7 THEN substr(text, 1, 7) || '…' ELSE text END AS start FROM (SELECT sample, string_agg(text, ' ' ORDER BY idx, c) AS text FROM cells GROUP BY 1)""")
def q90_cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _html(lambda m: " ".join(structure.cell_texts(m)), F.replace("markup", F.lit("<td>"), F.lit("<td> ")))
    return markup_tables(spark, sf_dir).select("sample", text.alias("text"), _html(lambda m: diffs.shortened(diffs.plain(m), 7)).alias("start"))


@query(f"{TABLES_SQL}, {CELLS} SELECT sample, idx::INT AS r, c::INT AS k, text FROM cells")
def q91_cells_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _html(lambda m: [dict(zip(("r", "k", "text"), x, strict=True)) for x in structure.cells_by_ordinal(m)], kind="array<struct<r: int, k: int, text: string>>")
    return markup_tables(spark, sf_dir).select("sample", F.inline(found))


@query(f"""{TABLES_SQL}, {CELLS}, f AS (SELECT sample, min(idx * 3 + c) FILTER (c = 2 AND text = 'F') AS place, max(idx) AS last, max_by(text, idx) FILTER (c = 0) AS final FROM cells GROUP BY 1)
SELECT sample, CASE sample % 3 WHEN 0 THEN CASE WHEN place IS NOT NULL THEN 'text ' || place || ': ''F'' / ''G''' END WHEN 1 THEN 'shape ' || (last + 1) || 'x3 / ' || CASE WHEN last = 0 THEN '0x0' ELSE last || 'x3' END || '; text ' || (last * 3) || ': ''' || final || ''' / None' ELSE 'markup' END AS callouts FROM f""")
def q92_first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's text replaced, the last row left out, or other markup inside of a cell."""
    k = F.col("sample") % 3
    other = F.when(k == 0, F.replace("markup", F.lit("<td>F</td></tr>"), F.lit("<td>G</td></tr>"))).when(k == 1, F.regexp_replace("markup", "<tr>(?!.*<tr>).*</tr>", "")).otherwise(F.regexp_replace("markup", "^<table><tr><td>([0-9]+)", "<table><tr><td><b>$1</b>"))
    found = _html(lambda a, c: "; ".join(structure.difference_callouts(a, c)) or None, F.col("markup"), other)
    return markup_tables(spark, sf_dir).select("sample", found.alias("callouts"))


_EDITED = f"""edited AS (SELECT l_orderkey AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx) - 1 AS r, l_partkey::VARCHAR AS t0, CASE WHEN l_partkey % 5 = 0 THEN l_returnflag || 'x' ELSE l_returnflag END AS t1, CASE WHEN l_suppkey % 7 <> 0 THEN l_linestatus END AS t2 FROM items WHERE l_partkey % 11 <> 0 OR idx = 0),
pred AS (SELECT sample, r, unnest([0, 1, 2]) AS c, unnest([t0, t1, t2]) AS a FROM edited)"""


@query(f"""{TABLES_SQL}, {CELLS}, {_EDITED}
SELECT sample, count(*) AS compared, count(*) FILTER (a IS DISTINCT FROM b) AS mismatches FROM (SELECT coalesce(p.sample, t.sample) AS sample, p.a, t.text AS b FROM (SELECT * FROM pred WHERE a IS NOT NULL) p FULL JOIN cells t ON p.sample = t.sample AND p.r = t.idx AND p.c = t.c) GROUP BY 1""")
def q26b_grid_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grid_difference(tables.logical_cells(markup_tables(spark, sf_dir, edit=True)), tables.logical_cells(markup_tables(spark, sf_dir)))


@query(f"""{TABLES_SQL}, {_EDITED}, m AS (SELECT sample, r, t0 || t1 || coalesce(t2, '') AS a FROM edited) SELECT sample, string_agg(a, '|' ORDER BY r) AS grid FROM m GROUP BY 1""")
def q93_display_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _html(lambda m: "|".join("".join(row) for row in structure.display_grid(markup.logical_cells(m))))
    return markup_tables(spark, sf_dir, edit=True).select("sample", grid.alias("grid"))


@query(f"{TABLES_SQL}, n AS (SELECT l_orderkey AS sample, count(*) AS n FROM items GROUP BY 1) SELECT sample, 1e0 AS teds_s, 1e0 - 1e0 / (n * 4) AS teds FROM n")
def q94_similarity_of_one_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity that follows from its definition: one cell's text replaced as a whole."""
    changed = F.regexp_replace("markup", "^<table><tr><td>[0-9]+<", "<table><tr><td>?????????????<")
    rows = markup_tables(spark, sf_dir)
    return tables.scored_pairs(rows.withColumn("markup", changed), rows).select("sample", "teds_s", "teds")


@query(f"{TABLES_SQL}, n AS (SELECT l_orderkey AS sample, count(*) AS n FROM items GROUP BY 1) SELECT sample, 1e0 - 4e0 / (n * 4 + 4) AS teds_s, 1e0 - 4e0 / (n * 4 + 4) AS teds FROM n")
def q95_similarity_of_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.replace("markup", F.lit("</table>"), F.lit("<tr><td>a</td><td>b</td><td>c</td></tr></table>"))
    rows = markup_tables(spark, sf_dir)
    return tables.scored_pairs(rows.withColumn("markup", more), rows).select("sample", "teds_s", "teds")


@query(f"""{TABLES_SQL}, n AS (SELECT sample, markup, regexp_replace(markup, '^<table><tr>.*?</tr>', '<table>') AS less, len(string_split(markup, '<tr>')) - 1 AS n FROM tables), s AS (SELECT *, CASE sample % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 1 - 4 * 1e0 / (n * 4) ELSE 1e0 END AS v FROM n)
SELECT sample, v AS teds_s, v AS teds, CASE sample % 3 WHEN 0 THEN 'no table' END AS error, CASE sample % 3 WHEN 0 THEN 1e0 WHEN 1 THEN (length(markup) - length(less)) / length(markup)::DOUBLE ELSE 0e0 END AS edit_distance FROM s""")
def q96_missing_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No prediction for a third of the tables, one without the first row for another, and the table itself."""
    rows = markup_tables(spark, sf_dir)
    less = F.regexp_replace("markup", "^<table><tr>.*?</tr>", "<table>")
    some = rows.where("sample % 3 > 0").withColumn("markup", F.when(F.col("sample") % 3 == 1, less).otherwise(F.col("markup")))
    return tables.scored_pairs(some, rows).select("sample", "teds_s", "teds", "error", "edit_distance")


@query(f"""{TABLES_SQL}, {CELLS}, k AS (SELECT sample, idx * 3 + c AS k, text FROM cells) SELECT sample, count(*)::INT AS cells, count(*)::INT AS regions, count(*)::INT AS mapped_cells, 0::INT AS skipped_regions, 1e0 AS coverage, 1e0 AS weighted_similarity, 'accepted' AS reason FROM k GROUP BY 1""")
def q97_alignment_of_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, F.xxhash64("sample"))  # small rows, much work
    return rows.select("sample", tables.alignment(F.col("texts"), F.col("texts")).alias("r")).select("sample", "r.*").drop("nonempty_cells")


@query(f"""{TABLES_SQL}, {PARTS} SELECT sample, list_filter([CASE WHEN true THEN 'raw_section_convention_mismatch' END, CASE WHEN true THEN 'normalized_thead_tbody_split_mismatch' END, CASE WHEN n > 1 THEN 'row_count_mismatch' END, CASE WHEN n > 1 THEN 'cell_count_mismatch' END,
  CASE WHEN n > 1 THEN 'structural_difference' ELSE 'content_only_difference' END], lambda x: x IS NOT NULL) AS labels FROM parts""")
def q98_difference_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with sections against their first rows alone."""
    rows = _sectioned(spark, sf_dir).withColumn("other", F.regexp_replace("markup", "^<table><thead>(.*?)</thead>.*$", "<table>$1</table>"))
    a, c = tables.markup_statistics(F.col("other")), tables.markup_statistics(F.col("markup"))
    more = c["tr"] > 1
    return rows.select("sample", s.difference_labels(a, c, a, c, F.when(more, 0.5).otherwise(1.0), F.lit(0.5)).alias("labels"))


#: Statistics of two tables by name: a number of each order's line items, and that number moved on where the other key says so.
_STATISTICS = ("thead", "tbody", "thead_tr", "tbody_tr", "tr", "td", "rowspan", "colspan", "empty_td")
_DIFFER = ", ".join(f"(p // {3 + k}) % {2 + k} = 0 AS {name}" for k, name in enumerate(_STATISTICS))
_COUNTS = ", ".join(f"CASE WHEN {name} THEN '{label}' END" for name, label in s.COUNT_LABELS)


@query(f"""{TABLES_SQL}, o AS (SELECT l_orderkey AS sample, sum(l_partkey)::BIGINT AS p, sum(l_suppkey)::BIGINT AS s FROM items GROUP BY 1), d AS (SELECT sample, p, s, {_DIFFER} FROM o)
SELECT sample, CASE WHEN len(found) = 0 THEN ['uncategorized'] ELSE found END AS labels FROM (SELECT sample, list_filter([CASE WHEN thead OR tbody THEN 'raw_section_convention_mismatch' END, CASE WHEN thead_tr OR tbody_tr THEN 'normalized_thead_tbody_split_mismatch' END,
  {_COUNTS}, CASE WHEN s % 3 = 0 THEN 'content_only_difference' END, CASE WHEN s % 3 = 1 THEN 'structural_difference' END], lambda x: x IS NOT NULL) AS found FROM d)""")
def q98b_all_difference_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that differ each on its own, so that each label occurs, in many combinations."""
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.sum("l_partkey").cast("long").alias("p"), F.sum("l_suppkey").cast("long").alias("s"))
    other = lambda k: F.when(F.floor(F.col("p") / (3 + k)) % (2 + k) == 0, F.col("p") + 1).otherwise(F.col("p"))
    a, c = F.struct(*[F.col("p").alias(x) for x in _STATISTICS]), F.struct(*[other(k).alias(x) for k, x in enumerate(_STATISTICS)])
    scored = F.when(F.col("s") % 3 == 1, 0.5).otherwise(1.0), F.when(F.col("s") % 3 == 2, 1.0).otherwise(0.5)
    return o.withColumns({"a": a, "c": c}).select("sample", s.difference_labels(F.col("a"), F.col("c"), F.col("a"), F.col("c"), *scored).alias("labels"))


@query(f"""{TABLES_SQL}, n AS (SELECT l_orderkey AS sample, count(*) AS n, min(l_suppkey) AS k FROM items GROUP BY 1), r AS (SELECT CASE WHEN k % 7 = 0 THEN 'missing_ocr' WHEN k % 7 = 1 THEN 'html_or_otsl' WHEN n > 5 THEN 'cell_count' WHEN k % 7 = 2 THEN 'no_regions' WHEN k % 7 = 3 THEN 'low_coverage' WHEN k % 7 = 4 THEN 'low_similarity' ELSE 'accepted' END AS reason FROM n)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def q99_rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("k"))
    k = F.col("k") % 7
    reason = s.pseudo_label_reason(k != 0, k != 1, F.col("n"), F.when(k != 2, 1), F.when(k == 3, 0.5).otherwise(0.9), F.when(k == 4, 0.5).otherwise(0.9), most_cells=5)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


#: Both ways in whole numbers and one division, so that the sums are the same in any order.
_GROUPS = f"""{BOXES_SQL}, p AS (SELECT sample, x0 AS v, count(*)::DOUBLE AS w FROM boxes GROUP BY 1, 2), k AS (SELECT sample, v, row_number() OVER (PARTITION BY sample ORDER BY v) AS i, count(*) OVER (PARTITION BY sample) AS n,
  sum(w) OVER s AS c, sum(w * v) OVER s AS s1, sum(w * v * v) OVER s AS s2, sum(w) OVER (PARTITION BY sample) AS tc, sum(w * v) OVER (PARTITION BY sample) AS t1, sum(w * v * v) OVER (PARTITION BY sample) AS t2 FROM p WINDOW s AS (PARTITION BY sample ORDER BY v)),
cuts AS (SELECT *, s1 / c AS a, (t1 - s1) / (tc - c) AS b, row_number() OVER (PARTITION BY sample ORDER BY (s2 - s1 * s1 / c) + ((t2 - s2) - (t1 - s1) * (t1 - s1) / (tc - c)), i) AS nth FROM k WHERE i < n),
best AS (SELECT sample, a, b FROM cuts WHERE nth = 1 UNION ALL SELECT sample, v, v FROM k WHERE n = 1)"""


@query(f"{_GROUPS} SELECT sample, k::INT AS k, CASE k WHEN 0 THEN 0e0 WHEN 1 THEN round_even((a + b) / 2, 0) ELSE 100e0 END AS edge, 'distribution' AS source FROM best, range(3) t(k)")
def q100_line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tracks for each order from its boxes' left edges, beside all ways to cut them in two."""
    items = boxes(spark, sf_dir).select("sample", F.col("box.x0").alias("position"))
    sizes = items.groupBy("sample").agg(F.lit(2).alias("n"), F.lit(0).alias("low"), F.lit(100).alias("high"))
    return tracks.track_edges(items, sizes)


@query(f"""{BOXES_SQL}, n AS (SELECT sample, count(DISTINCT x0) AS lines, count(DISTINCT x0) - 1 + sample % 2 AS n FROM boxes GROUP BY 1, sample), r AS (SELECT sample, x0, row_number() OVER (PARTITION BY sample ORDER BY x0) - 1 AS k FROM (SELECT DISTINCT sample, x0 FROM boxes))
SELECT sample, k::INT AS k, x0::DOUBLE AS edge, 'line' AS source FROM r JOIN n USING (sample) WHERE sample % 2 = 0 AND n > 0 AND k <= n
UNION ALL SELECT sample, t.k::INT, round_even(t.k * (100e0 / n), 0), 'uniform' FROM n, LATERAL (SELECT unnest(range(0, n + 1)) AS k) t WHERE sample % 2 = 1
UNION ALL SELECT sample, 0, 0e0, 'uniform' FROM n WHERE n = 0""")
def q100b_ruled_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left edges as ruling lines: enough of them for every other order, one too few, and no positions, for the others."""
    lines = boxes(spark, sf_dir).select("sample", F.col("box.x0").alias("position"))
    sizes = lines.groupBy("sample").agg((F.count_distinct("position") - 1 + F.col("sample") % 2).alias("n"), F.lit(0).alias("low"), F.lit(100).alias("high"))
    return tracks.track_edges(lines.where("false"), sizes, lines)



@query(f"""{TABLES_SQL}, {CELLS} SELECT sample, (idx * 3 + c)::INT AS cell_idx, '{{' || chr(125) AS nothing, CASE WHEN c = 1 THEN '-1.0 -1.0 -1.0 -1.0 1 ' ELSE printf('%.2f %.2f %.2f %.2f 2 ', c * 10e0, 0e0, c * 10e0 + 8, 5e0) || text END AS line FROM cells""")
def q101_gold_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import training

    cells = _boxed_cells(spark, sf_dir)
    line = training.gold_coordinate(F.col("text"), F.when(F.col("c0") != 1, F.col("box")))
    return cells.select("sample", "cell_idx", F.lit("{}").alias("nothing"), line.alias("line"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in pairs for each cell, in the order opposite to the cells'."""
    return boxes(spark, sf_dir).select("sample", (100 - F.floor(F.col("idx") / 2)).cast("int").alias("cell_idx"), F.concat(F.lit("t"), F.floor(F.col("idx") / 2).cast("string")).alias("text"), F.col("idx").alias("region_idx"), "box")


@query(f"""{BOXES_SQL} SELECT sample, (idx // 2)::INT AS group_idx, (100 - idx // 2)::INT AS cell_idx, 't' || (idx // 2) AS text, count(*)::INT AS boxes, sum(x0)::BIGINT AS x0 FROM boxes GROUP BY ALL""")
def q102_coordinate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import training

    groups = training.coordinate_groups(_mapped(spark, sf_dir)).select("sample", F.explode("dr_coord").alias("group_idx", "e"))
    return groups.select("sample", "group_idx", "e.cell_idx", "e.text", F.size("e.boxes").alias("boxes"), F.aggregate("e.boxes", F.lit(0).cast("long"), lambda a, x: a + x["x0"]).alias("x0"))


@query(f"""{BOXES_SQL} SELECT sample, idx::INT AS region_idx, x0, CASE WHEN idx % 2 = 0 THEN 't' || (idx // 2) ELSE '' END AS text, 1e0 AS score FROM boxes""")
def q103_regions_of_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import training

    return training.regions_of_groups(training.coordinate_groups(_mapped(spark, sf_dir))).select("sample", "region_idx", F.col("box.x0").alias("x0"), "text", "score")


def _grid_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A grid of three columns, 20 by 10 pixels each place, whose middle cells have no box."""
    idx = F.col("idx")
    row, column = F.floor(idx / 3).cast("int"), F.pmod(idx, F.lit(3)).cast("int")
    box = F.struct((column * 20).cast("double").alias("x0"), (row * 10).cast("double").alias("y0"), (column * 20 + 20).cast("double").alias("x1"), (row * 10 + 10).cast("double").alias("y1"))
    cells = boxes(spark, sf_dir).select("sample", idx.alias("cell_idx"), row.alias("r0"), (row + 1).alias("r1"), column.alias("c0"), (column + 1).alias("c1"), F.when((column != 1) | (row > 0), box).alias("box"))
    some = cells.groupBy("sample").agg(F.count("*").alias("n")).where("n >= 6").select("sample")
    return cells.join(some, "sample"), some.select("sample", F.lit(60).alias("width"), F.lit(40).alias("height"))


_GRID = f"{BOXES_SQL}, grid AS (SELECT sample FROM boxes GROUP BY 1 HAVING count(*) >= 6)"


@query(f"{_GRID} SELECT sample, idx::INT AS cell_idx, (idx % 3 * 20)::DOUBLE AS x0, (idx // 3 * 10)::DOUBLE AS y0, (idx % 3 * 20 + 20)::DOUBLE AS x1, (idx // 3 * 10 + 10)::DOUBLE AS y1, (idx = 1) AS reconstructed FROM boxes JOIN grid USING (sample)")
def q104_rebuilt_from_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular grid, whose missing box has one right answer."""
    return _flat(reconstruct.with_boxes(*_grid_cells(spark, sf_dir), "edges"))


def _flat(cells: DataFrame) -> DataFrame:
    return cells.select("sample", "cell_idx", "box.*", "reconstructed")


@query(f"{_GRID} SELECT sample, idx::INT AS cell_idx, (idx % 3 * 20)::DOUBLE AS x0, (idx // 3 * 10)::DOUBLE AS y0, (idx % 3 * 20 + 20)::DOUBLE AS x1, (idx // 3 * 10 + 10)::DOUBLE AS y1, (idx = 1) AS reconstructed FROM boxes JOIN grid USING (sample)")
def q105_rebuilt_from_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(reconstruct.with_boxes(*_grid_cells(spark, sf_dir), "centres"))


@query(f"{_GRID} SELECT sample, idx::INT AS cell_idx, (idx % 3 * 20)::DOUBLE AS x0, (idx // 3 * 10)::DOUBLE AS y0, (idx % 3 * 20 + 20)::DOUBLE AS x1, (idx // 3 * 10 + 10)::DOUBLE AS y1, (idx = 1) AS reconstructed FROM boxes JOIN grid USING (sample)")
def q106_rebuilt_from_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(reconstruct.with_boxes(*_grid_cells(spark, sf_dir), "bands"))


@query(f"{_GRID} SELECT sample, 22e0 AS x0, 0e0 AS y0, 41e0 AS x1, 10e0 AS y1 FROM grid")
def q107_rebuilt_from_ruled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner lines move to ruling lines nearby; rows without any near stay."""
    cells, extents = _grid_cells(spark, sf_dir)
    ruled = extents.select("sample", F.inline(F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(v).alias("line")) for a, v in (("x", 22.0), ("x", 41.0), ("y", 500.0))))))
    made = reconstruct.with_boxes(cells, extents, "centres", reconstruct.snapped_lines(cells, extents, ruled))
    return _flat(made.where("reconstructed")).drop("cell_idx", "reconstructed")


@query(f"""{BOXES_SQL}, n AS (SELECT sample, count(*) AS n, CASE WHEN count(*) > 1 THEN sample % 6 ELSE 5 END AS k FROM boxes GROUP BY 1, sample)
SELECT sample, n AS cells, (k < 5)::BIGINT AS reconstructed, (k = 0)::BIGINT AS invalid, (k IN (1, 4))::BIGINT AS overlaps, (k IN (2, 4))::BIGINT AS huge, CASE k WHEN 0 THEN 'invalid_zero_area' WHEN 1 THEN 'overlap_from_tight_text_boundaries' WHEN 2 THEN 'oversized_interpolated_cells' WHEN 3 THEN 'reconstructed_without_detected_geometry_issue'
  WHEN 4 THEN 'overlap_from_tight_text_boundaries;oversized_interpolated_cells' ELSE 'no_reconstruction_needed' END AS causes FROM n""")
def q108_reconstruction_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second box of each grid was made anew: without an area, over its neighbour, far too large, as it should be, large and over its neighbour, or not at all."""
    idx, k = F.col("idx"), F.col("sample") % 6
    row, column = F.floor(idx / 3).cast("int"), (idx % 3).cast("int")
    edge = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    made = g.box(edge(20.0, 10.0, 20.0, 20.0, 10.0, 20.0), edge(0.0, 0.0, -400.0, 0.0, -400.0, 0.0), edge(20.0, 40.0, 40.0, 40.0, 40.0, 40.0), edge(10.0, 10.0, 0.0, 10.0, 10.0, 10.0))
    plain = g.box((column * 20).cast("double"), (row * 10).cast("double"), (column * 20 + 20).cast("double"), (row * 10 + 10).cast("double"))
    cells = boxes(spark, sf_dir).select("sample", idx.alias("cell_idx"), row.alias("r0"), (row + 1).alias("r1"), column.alias("c0"), (column + 1).alias("c1"), F.when(idx == 1, made).otherwise(plain).alias("box"), ((idx == 1) & (k < 5)).alias("reconstructed"))
    extents = cells.select("sample").distinct().select("sample", F.lit(60).alias("width"), F.lit(40).alias("height"))
    return reconstruct.diagnostics(cells, extents).select("sample", "cells", "reconstructed", "invalid", "overlaps", "huge", "causes")


@query(f"{BOXES_SQL}, l AS (SELECT sample, idx, x0, x0 + (idx % 3) * 2 - 1 AS line FROM boxes WHERE idx = 0) SELECT sample, idx::INT AS idx, (x0 - 1)::DOUBLE AS position FROM l")
def q109_nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    guesses = boxes(spark, sf_dir).where("idx = 0").select("sample", "idx", F.col("box.x0").cast("double").alias("guess"))
    lines = guesses.select("sample", F.explode(F.array(F.col("guess") - 1, F.col("guess") + 4)).alias("line"))
    return b.nearest_line(guesses, lines, F.lit(100.0)).select("sample", "idx", "position")


@query(f"""{TABLES_SQL}, k AS (SELECT l_orderkey AS sample, count(*) AS cells, count(*) FILTER (l_suppkey % 3 <> 0) AS mapped, sum(length(l_partkey::VARCHAR)) AS size, coalesce(sum(length(l_partkey::VARCHAR)) FILTER (l_suppkey % 3 <> 0), 0) AS covered FROM items GROUP BY 1),
r AS (SELECT *, CASE WHEN mapped = 0 THEN 'no_regions' WHEN covered / size::DOUBLE < 0.78 THEN 'low_coverage' ELSE 'accepted' END AS reason FROM k)
SELECT reason, count(*) AS n, sum(cells)::BIGINT AS cells, sum(mapped)::BIGINT AS mapped_cells, 0::BIGINT AS skipped_regions, round(sum(covered / size::DOUBLE), 6) AS coverage FROM r GROUP BY 1""")
def q27b_funnel_of_lost_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the numbers of parts against the regions of most of them: what is left out lowers the coverage, nothing else."""
    li = table(spark, sf_dir, "lineitem")
    idx = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER))
    rows = li.select(F.col("l_orderkey").alias("sample"), F.struct(idx.alias("idx"), F.col("l_partkey").cast("string").alias("t"), (F.col("l_suppkey") % 3 != 0).alias("there")).alias("x"))
    lists = rows.groupBy("sample").agg(F.array_sort(F.collect_list("x")).alias("x")).repartition(spark.sparkContext.defaultParallelism, F.xxhash64("sample"))
    texts = lambda some: F.transform(some, lambda x: x["t"])
    report = lists.select(tables.alignment(texts("x"), texts(F.filter("x", lambda x: x["there"]))).alias("r")).select("r.*")
    total = lambda c: F.sum(c).cast("long").alias(c)
    return report.groupBy("reason").agg(F.count("*").alias("n"), *map(total, ("cells", "mapped_cells", "skipped_regions")), F.round(F.sum("coverage"), 6).alias("coverage"))


#: Texts of one letter each: their common subsequence is as long as that letter is frequent in both. v: the best values of the first i cells against each number of first regions.
_ALIGN = f"""{TABLES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, t AS (SELECT l_orderkey AS sample, idx, lower(l_returnflag) AS f, 1 + l_quantity::BIGINT % 4 AS n, l_partkey AS p, l_suppkey AS s FROM items),
c AS (SELECT sample, list(repeat(f, n::INT) ORDER BY idx) AS cells, flatten(list(CASE p % 3 WHEN 0 THEN [f, repeat(f, n::INT)] WHEN 1 THEN [repeat(f, n::INT + 1)] ELSE [repeat(f, n::INT)] END || CASE WHEN s % 4 = 0 THEN ['zz'] ELSE [] END ORDER BY idx)) AS r FROM t GROUP BY 1),
walk AS (SELECT sample, cells, r, 0 AS i, list_transform(range(0, len(r) + 1), lambda j: -0.28e0 * j) AS v FROM c
  UNION ALL SELECT sample, cells, r, i + 1, list_transform(range(0, len(r) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: base[k + 1] - 0.28e0 * (j - k)))) FROM (
    SELECT sample, cells, r, i, list_transform(range(0, len(r) + 1), lambda j: list_max([v[j + 1] - 0.85e0] || list_transform(range(1, least(8, j) + 1), lambda m: v[j - m + 1] - 0.72e0 - 0.025e0 * (m - 1) + 4e0 *
      least(length(cells[i + 1]), length(array_to_string(r[j - m + 1 : j], '')) - length(replace(array_to_string(r[j - m + 1 : j], ''), cells[i + 1][1], ''))) / (length(cells[i + 1]) + length(array_to_string(r[j - m + 1 : j], '')))))) AS base
    FROM walk WHERE i < len(cells)))"""


@query(f"{_ALIGN} SELECT sample, len(cells)::INT AS cells, len(r)::INT AS regions, round(v[len(r) + 1], 6) AS value FROM walk WHERE i = len(cells)")
def q110_alignment_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value of aligning each order's cells with regions that are cut in two, longer, or strange, beside the recurrence in SQL."""
    li = table(spark, sf_dir, "lineitem")
    idx, f, n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)), F.col("l_returnflag"), (1 + F.col("l_quantity").cast("long") % 4).cast("int")
    p = F.col("l_partkey") % 3
    some = F.when(p == 0, F.array(f, F.repeat(f, n))).when(p == 1, F.array(F.repeat(f, n + 1))).otherwise(F.array(F.repeat(f, n)))
    more = F.when(F.col("l_suppkey") % 4 == 0, F.array(F.lit("zz"))).otherwise(F.array().cast("array<string>"))
    rows = li.select(F.col("l_orderkey").alias("sample"), F.struct(idx.alias("idx"), F.repeat(f, n).alias("c"), F.concat(some, more).alias("r")).alias("x")).groupBy("sample").agg(F.array_sort(F.collect_list("x")).alias("x"))
    both = rows.select("sample", F.transform("x", lambda x: x["c"]).alias("c"), F.flatten(F.transform("x", lambda x: x["r"])).alias("r")).repartition(spark.sparkContext.defaultParallelism, F.xxhash64("sample"))
    return both.select("sample", F.size("c").alias("cells"), F.size("r").alias("regions"), F.round(tables.alignment_value(F.col("c"), F.col("r")), 6).alias("value"))


@query(f"{_GRID} SELECT sample, max(idx // 3 + 1)::INT AS num_rows, 3::INT AS num_cols, count(*) AS total_cells, 1::BIGINT AS reconstructed_bboxes, max(CASE WHEN idx = 1 AND text = 'N' THEN 1 ELSE 0 END)::BIGINT AS reconstructed_empty_bboxes FROM boxes JOIN grid USING (sample) GROUP BY 1")
def q187_reconstruction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, extents = _grid_cells(spark, sf_dir)
    texts = boxes(spark, sf_dir).select("sample", F.col("idx").alias("cell_idx"), F.when(F.col("text") == "N", "<b> </b>").otherwise(F.col("text")).alias("text"))
    return reconstruct.reconstruction_counts(reconstruct.with_boxes(cells, extents, "edges").join(texts, ["sample", "cell_idx"]))
