"""Structure tokens and training forms of tables: sections, text put into places, OTSL with contents, types. Pure Python."""

from __future__ import annotations

import re
from itertools import accumulate

from .markup import CELLS, Cell, Node, first_table, rows_of
from .text import normalise


def unwrapped(tokens: list[str]) -> list[str]:
    """Without the tags of a table around all others, either of which may be missing."""
    first = 1 if tokens and tokens[0] == "<table>" else 0
    last = len(tokens) - 1 if len(tokens) > first and tokens[-1] == "</table>" else len(tokens)
    return tokens[first:last]


def top_rows(tokens: list[str]) -> list[slice]:
    """Where the closed rows that are in no other row stand: a row begins where the nesting rises from 0 and ends where it falls back."""
    steps = [(t == "<tr>") - (t == "</tr>") for t in tokens]
    depth = list(accumulate(steps, lambda d, s: max(d + s, 0), initial=0))
    begins = [k for k, s in enumerate(steps) if s > 0 and depth[k] == 0]
    ends = [k + 1 for k, s in enumerate(steps) if s < 0 and depth[k] == 1]
    return [slice(a, b) for a, b in zip(begins, ends, strict=False)]


def sectioned(tokens: list[str], first_row_is_head: bool = False) -> list[str]:
    """Tokens with a head and a body. What has a head stays. Else the head is empty and the body has all, or, if asked for and there are rows, the head has the first row and the body the other rows alone."""
    inner = unwrapped(tokens)
    if "<thead>" in inner and "</thead>" in inner:
        return inner
    rows = top_rows(inner) if first_row_is_head else []
    parts = {"thead": inner[rows[0]] if rows else [], "tbody": [t for r in rows[1:] for t in inner[r]] if rows else inner}
    return [t for name, part in parts.items() for t in (f"<{name}>", *part, f"</{name}>")]


def _span(tag: str, name: str) -> int:
    found = re.search(rf'{name}="?(\d+)', tag)
    return max(1, int(found[1])) if found else 1


def placed_text(tokens: list[str], text_at: dict[tuple[int, int], str]) -> str:
    """Tokens of empty cells with the text of each cell's first place (row, column), so that empty cells stay empty."""
    out, taken = ["<table>"] if tokens else [], set()
    row, column, here, tag = -1, 0, None, ""
    for token in tokens:
        if tag or re.match(r"<t[dh](?![a-z])", token):
            tag += token
            if ">" in token:
                while (row, column) in taken:
                    column += 1
                here, tag = (column, _span(tag, "rowspan"), _span(tag, "colspan")), ""
        elif token == "<tr>":
            row, column = row + 1, 0
        elif token in ("</td>", "</th>") and here:
            first, high, wide = here
            out.append(text_at.get((row, first), ""))
            taken |= {(r, c) for r in range(row + 1, row + high) for c in range(first, first + wide)}
            column, here = first + wide, None
        out.append(token)
    return "".join([*out, "</table>"] if tokens else out)


def texts_in_order(tokens: list[str], texts: list[str]) -> str:
    """Tokens of empty cells with the texts one after another; cells beyond the texts stay empty."""
    left = iter(texts)
    return "".join(next(left, "") + t if t in ("</td>", "</th>") else t for t in tokens)


def otsl_markup(tokens: list[str], texts: list[str]) -> str:
    """Rows of OTSL tokens with texts in order; lcel widens the cell before it, every other token takes a text. Raises ValueError if their numbers differ."""
    rows: list[list[list]] = [[]]
    left = iter(texts)
    for token in (t.strip().lower() for t in tokens):
        if token == "nl":
            rows.append([])
        elif token == "lcel" and rows[-1]:
            rows[-1][-1][1] += 1
        elif token != "lcel":
            text = next(left, None)
            if text is None:
                raise ValueError("fewer texts than cells")
            rows[-1].append([text, 1])
    if next(left, None) is not None:
        raise ValueError("more texts than cells")
    wide = lambda n: f' colspan="{n}"' if n > 1 else ""
    return "".join("<tr>" + "".join(f"<td{wide(n)}>{t}</td>" for t, n in row) + "</tr>" for row in rows if row)


def otsl_markup_by_row(tokens: list[str], rows: list[list[str]]) -> str:
    """Rows of OTSL tokens with the texts of each row. Raises ValueError if there are not as many rows, or if a row has not as many texts as cells."""
    given: list[list[str]] = [[]]
    for token in (t.strip().lower() for t in tokens):
        given.append([]) if token == "nl" else given[-1].append(token)
    given = [row for row in given if row]
    if len(given) != len(rows):
        raise ValueError(f"{len(rows)} rows of texts for {len(given)} rows")
    for k, (row, texts) in enumerate(zip(given, rows, strict=True)):
        if (n := sum(t != "lcel" for t in row)) != len(texts):
            raise ValueError(f"row {k}: {len(texts)} texts for {n} cells")
    return otsl_markup(tokens, [text for texts in rows for text in texts])


def type_by_spans(markup: str | None) -> str:
    """`complex` if a span of a cell is over 1 or no number."""
    spans = [cell.attrs[s].strip() for cell in _cells(markup) for s in ("rowspan", "colspan") if s in cell.attrs]
    return "complex" if any(not re.fullmatch(r"\d+", s) or int(s) > 1 for s in spans) else "simple"


def type_by_sections(markup: str | None) -> str:
    """`complex` if the table has a head or a body."""
    table = first_table(markup)
    return "complex" if table and any(n.tag in ("thead", "tbody") for n in table.walk()) else "simple"


def _cells(markup: str | None) -> list[Node]:
    return _cells_of(first_table(markup))


def _cells_of(table: Node | None) -> list[Node]:
    return [n for n in table.walk() if n.tag in CELLS] if table else []


def cell_texts(markup: str | None) -> list[str]:
    """Texts, in compatible composed characters, of the cells that have any."""
    return [t for t in (normalise(c.text()) for c in _cells(markup)) if t]


def difference_callouts(a: str | None, b: str | None) -> list[str]:
    """What a reader is told of two tables: other shapes, the first texts that differ, and other markup inside of equal texts."""
    tables = [first_table(a), first_table(b)]
    cells = [_ordinals(t) for t in tables]
    shapes = [(len(rows), max(map(len, rows), default=0)) for rows in map(_grouped, cells)]
    out = [f"shape {shapes[0][0]}x{shapes[0][1]} / {shapes[1][0]}x{shapes[1][1]}"] if shapes[0] != shapes[1] else []
    if found := _first_difference(*cells):
        out.append(f"text {found[0]}: {found[1]!r} / {found[2]!r}")
    if not out:
        inner = [[sorted(n.tag for c in cell.elements() for n in c.walk()) for cell in _cells_of(t)] for t in tables]
        if inner[0] != inner[1]:
            out.append("markup")
    return out


def _grouped(cells: list[tuple[int, int, str]]) -> list[list[str]]:
    rows: dict[int, list[str]] = {}
    for r, _, text in cells:
        rows.setdefault(r, []).append(text)
    return list(rows.values())


def cells_by_ordinal(markup: str | None) -> list[tuple[int, int, str]]:
    """(row, ordinal in the row, text): without regard to spans."""
    return _ordinals(first_table(markup))


def _ordinals(table: Node | None) -> list[tuple[int, int, str]]:
    return [(r, k, " ".join(c.text().split())) for r, (row, _) in enumerate(rows_of(table) if table else ()) for k, c in enumerate(x for x in row.elements() if x.tag in CELLS)]


def first_difference(a: str | None, b: str | None) -> tuple[int, str | None, str | None] | None:
    """(place, text, text) of the first cells, in order, whose texts differ."""
    return _first_difference(cells_by_ordinal(a), cells_by_ordinal(b))


def _first_difference(x: list[tuple[int, int, str]], y: list[tuple[int, int, str]]) -> tuple[int, str | None, str | None] | None:
    for k in range(max(len(x), len(y))):
        s, t = (v[k][2] if k < len(v) else None for v in (x, y))
        if s != t:
            return k, s, t
    return None


def display_grid(cells: list[Cell], rows: int = 40, columns: int = 24) -> list[list[str]]:
    """A preview: a cell's text at its first place, an arrow at its others."""
    high, wide = (min(most, max((getattr(c, end) for c in cells), default=0)) for most, end in ((rows, "r1"), (columns, "c1")))
    grid = [[""] * wide for _ in range(high)]
    for cell in cells:
        for r in range(cell.r0, min(cell.r1, high)):
            for c in range(cell.c0, min(cell.c1, wide)):
                grid[r][c] = cell.text if (r, c) == (cell.r0, cell.c0) else "↳"
    return grid
