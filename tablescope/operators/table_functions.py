"""Table functions for lateral joins: the logical cells of markup, of structure tokens and of OTSL tokens, a row each.

In SQL, after `register(spark)`: SELECT t.sample, c.* FROM t, LATERAL cells_of_markup(t.markup) c. In the DataFrame API:
`tables.lateralJoin(cells_of_markup(F.col("markup").outer()))`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import markup

GRID = "cell_idx int, r0 int, r1 int, c0 int, c1 int"


def _rows(cells: list[markup.Cell]) -> Iterator[tuple]:
    for k, c in enumerate(cells):
        yield k, c.r0, c.r1, c.c0, c.c1


class _TableCells:
    """Of markup, with texts; null markup and markup without a table have none."""

    def eval(self, text: str) -> Iterator[tuple]:
        cells = markup.logical_cells(text)
        for row, c in zip(_rows(cells), cells, strict=True):
            yield *row, c.text, c.header


class _TokenCells:
    """Of structure tokens, as far as there are contents; null tokens have none."""

    def eval(self, tokens: list, contents: int) -> Iterator[tuple]:
        yield from _rows(markup.annotated_cells(tokens or [], contents or 0)[0])


class _OtslCells:
    """Of OTSL tokens; short rows are filled up with empty cells."""

    def eval(self, tokens: list) -> Iterator[tuple]:
        cells = markup.otsl_cells(tokens or [])
        for row, c in zip(_rows(cells), cells, strict=True):
            yield *row, c.header


cells_of_markup = F.udtf(_TableCells, returnType=f"{GRID}, text string, header boolean")
cells_of_tokens = F.udtf(_TokenCells, returnType=GRID)
cells_of_otsl = F.udtf(_OtslCells, returnType=f"{GRID}, header boolean")


def register(spark: SparkSession) -> None:
    for name, f in (("cells_of_markup", cells_of_markup), ("cells_of_tokens", cells_of_tokens), ("cells_of_otsl", cells_of_otsl)):
        spark.udtf.register(name, f)
