"""Table markup: a small tree, logical cells, structure tokens, OTSL, and named canonicalisation policies. Pure Python.

Recovery rules of the parser, where markup is malformed: an end tag closes the nearest open element of its name, and what
is open inside it; one without a match is ignored; a new row, cell or section closes an open one of its table; what is
open at the end is closed. Comments and declarations are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import escape, unescape
from html.parser import HTMLParser
from itertools import groupby

from . import trees

VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "col"))
SECTIONS = ("thead", "tbody", "tfoot")
CELLS = ("td", "th")
#: A tag that begins closes open ones of these names, up to the table that they are in.
CLOSES = {"tr": ("tr", *CELLS), "td": CELLS, "th": CELLS, **dict.fromkeys(SECTIONS, (*SECTIONS, "tr", *CELLS))}


@dataclass(slots=True)
class Node:
    """An element; children are elements and strings."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.elements():
            yield from c.walk()

    def text(self) -> str:
        return "".join(c.text() if isinstance(c, Node) else c for c in self.children)

    def without(self, tags: tuple[str, ...]) -> Node:
        """With the contents of elements of these names in their places."""
        children: list = []
        for c in self.children:
            if isinstance(c, str):
                children.append(c)
            elif c.tag in tags:
                children += c.without(tags).children
            else:
                children.append(c.without(tags))
        return Node(self.tag, self.attrs, children)

    def size(self) -> int:
        return sum(1 for _ in self.walk())

    def span(self, name: str) -> int:
        """A span of at least 1; what is no whole number counts as 1."""
        if (value := self.attrs.get(name)) is None:
            return 1
        return max(1, int(value)) if re.fullmatch(r"\d{1,6}", value.strip(), re.ASCII) else 1

    def markup(self) -> str:
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        inside = "".join(c.markup() if isinstance(c, Node) else c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for c in self.children)
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{inside}</{self.tag}>")


class _Open:
    """A tree as it grows: the elements that are open, from the document on."""

    def __init__(self) -> None:
        self.open = [Node("document")]

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        if not closed and (wanted := CLOSES.get(tag)):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == "table":
                    break
                if self.open[k].tag in wanted:
                    del self.open[k:]
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if not closed and tag not in VOID:
            self.open.append(node)

    def end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def data(self, text: str) -> None:
        self.open[-1].children.append(text)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = _Open()
        self.handle_endtag, self.handle_data = self.tree.end, self.tree.data

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tree.start(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tree.start(tag, {k: v or "" for k, v in attrs}, True)


#: Tags with plainly written attributes, text, and comments without dashes. Any other `<`, and elements whose content is no markup, are the library parser's.
_PLAIN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z][A-Za-z0-9-]*=(?:\"[^\"&<>]*\"|'[^'&<>]*'))*)\s*(/?)>|([^<]+)|(<!--[^<>-]*-->)|<")
_ATTRIBUTE = re.compile(r"([A-Za-z][A-Za-z0-9-]*)=(?:\"([^\"]*)\"|'([^']*)')")
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "plaintext", "noscript"))


def _plain_tree(markup: str) -> _Open | None:
    """The tree of markup that is all plainly written; None of any other."""
    tree = _Open()
    for end, tag, attrs, closed, text, comment in _PLAIN.findall(markup):
        if text:
            tree.data(unescape(text) if "&" in text else text)
        elif comment:
            continue
        elif not tag or (tag := tag.lower()) in _RAW or (end and (attrs or closed)):
            return None
        elif end:
            tree.end(tag)
        else:
            tree.start(tag, {k.lower(): a or b for k, a, b in _ATTRIBUTE.findall(attrs)} if attrs else {}, bool(closed))
    return tree


def parse(markup: str | None) -> Node:
    markup = (markup or "").lstrip("\ufeff")
    if (tree := _plain_tree(markup)) is None:
        builder = _Builder()
        builder.feed(markup)
        builder.close()
        tree = builder.tree
    return tree.open[0]


def first_table(markup: str | None) -> Node | None:
    return next((n for n in parse(markup).walk() if n.tag == "table"), None)


def as_document(markup: str | None) -> str:
    """A fragment as a whole document, without declarations and byte order mark; a document stays as it is."""
    body = re.sub(r"<\?xml[^>]*\?>", "", (markup or "").lstrip("﻿")).strip()
    return body if re.match(r"(<!doctype|<html)", body, re.IGNORECASE) else f"<html><body>{body}</body></html>"


# Logical cells


@dataclass(frozen=True)
class Cell:
    """A cell of the logical grid, with half-open rows and columns."""

    r0: int
    r1: int
    c0: int
    c1: int
    text: str = ""
    header: bool = False

    def area(self) -> int:
        return max(0, self.r1 - self.r0) * max(0, self.c1 - self.c0)


def rows_of(table: Node, nested: bool = False) -> list[tuple[Node, bool]]:
    """(row, in a head) of a table's own rows, or of all rows in it."""
    if nested:
        return [(n, False) for n in table.walk() if n.tag == "tr"]
    out = []
    for child in table.elements():
        if child.tag == "tr":
            out.append((child, False))
        elif child.tag in SECTIONS:
            out += [(row, child.tag == "thead") for row in child.elements() if row.tag == "tr"]
    return out


def place(rows: list[list[tuple[int, int, str, bool]]]) -> list[Cell]:
    """Rows of (rowspan, colspan, text, header) on the grid: a cell takes the first column that is free when it comes."""
    taken: dict[int, set[int]] = {}
    out = []
    for r, row in enumerate(rows):
        c = 0
        for high, wide, text, header in row:
            while c in taken.get(r, ()):
                c += 1
            for rr in range(r, r + high):
                taken.setdefault(rr, set()).update(range(c, c + wide))
            out.append(Cell(r, r + high, c, c + wide, text, header))
            c += wide
    return out


#: A table of rows of plain cells and nothing else.
_REGULAR = re.compile("<table>(?:<tr>(?:<td>[^<&]*</td>)*+</tr>)*+</table>")


def _plain_rows(markup: str | None) -> list[str] | None:
    """The rows, without their end tags, of a table of rows of plain cells and nothing else; None of any other markup."""
    return markup[len("<table>") : -len("</table>")].split("</tr>")[:-1] if markup and _REGULAR.fullmatch(markup) else None


def _squashed(markup: str) -> bool:
    """Whether there are no blanks in plain cells that squashing would change."""
    return " ".join(markup.split()) == markup and "> " not in markup and " <" not in markup


def logical_cells(markup: str | None, nested: bool = False) -> list[Cell]:
    """The cells of the first table; no table, none."""
    if (rows := _plain_rows(markup)) is not None:  # cells where they stand
        return [Cell(r, r + 1, c, c + 1, " ".join(text[len("<td>") :].split())) for r, row in enumerate(rows) for c, text in enumerate(row[len("<tr>") :].split("</td>")[:-1])]
    table = first_table(markup)
    if table is None:
        return []
    return place([
        [(cell.span("rowspan"), cell.span("colspan"), " ".join(cell.text().split()), head or cell.tag == "th") for cell in row.elements() if cell.tag in CELLS]
        for row, head in rows_of(table, nested)
    ])


def cell_texts(markup: str | None) -> tuple[int, list[str]]:
    """The rows that the logical cells of the first table reach, and the cells' texts in order."""
    if (rows := _plain_rows(markup)) is None:
        cells = logical_cells(markup)
        return max((c.r1 for c in cells), default=0), [c.text for c in cells]
    texts = [row[len("<tr>") :].split("</td>")[:-1] for row in rows]
    return max((r + 1 for r, row in enumerate(texts) if row), default=0), [" ".join(text[len("<td>") :].split()) for row in texts for text in row]


def ended(cells: list[tuple[int, int, int, int]], mode: str) -> list[Cell]:
    """Saved cells (first row, end row, first column, end column) whose ends are inclusive, exclusive, or, in `compat`, exclusive ones read as inclusive."""
    extra = {"exclusive": 0, "inclusive": 1, "compat": 1}[mode]
    return [Cell(r0, r1 + extra, c0, c1 + extra) for r0, r1, c0, c1 in cells]


def cell_iou(a: Cell, b: Cell) -> float:
    both = max(0, min(a.r1, b.r1) - max(a.r0, b.r0)) * max(0, min(a.c1, b.c1) - max(a.c0, b.c0))
    union = a.area() + b.area() - both
    return both / union if both and union else 0.0


def greedy_match(iou: list[tuple[float, int, int]], least: float = 0.5) -> list[tuple[int, int]]:
    """Pairs of (value, predicted, true) taken from the highest on, ties to higher numbers, each side once."""
    left, right, out = set(), set(), []
    for value, p, t in sorted(iou, reverse=True):
        if value >= least and p not in left and t not in right:
            left.add(p)
            right.add(t)
            out.append((p, t))
    return out


def match_scores(pred: int, true: int, matched: int) -> tuple[float, float, float]:
    """Precision, recall and F1; two empty sides agree."""
    if not pred and not true:
        return 1.0, 1.0, 1.0
    p, r = matched / pred if pred else 0.0, matched / true if true else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


# Tokens


def table_shape(tokens: list[str]) -> tuple[int, int]:
    """Rows and most columns, by colspan alone; a start tag in parts ends at a token with '>'."""
    rows = columns = here = 0
    k = 0
    while k < len(tokens):
        token = tokens[k]
        if re.match(r"<tr(?![a-z])", token):
            rows, here = rows + 1, 0
        elif token.startswith(("<td", "<th")) and not token.startswith(("<thead", "<tbody", "<tfoot")):
            whole = token
            while ">" not in whole and k + 1 < len(tokens):
                k += 1
                whole += tokens[k]
            found = re.search(r'colspan="?(\d+)', whole)
            here += int(found[1]) if found else 1
            columns = max(columns, here)
        k += 1
    return rows, columns


def token_rows(tokens: list[str]) -> list[list[tuple[int, int]]]:
    """(rowspan, colspan) of each cell of each row of structure tokens; a start tag in parts ends at a token with '>'; cells before the first row are none."""
    rows: list[list[tuple[int, int]]] = []
    tag = ""
    for token in tokens:
        if tag or re.match(r"<t[dh](\s|>|$)", token):
            tag += token
            if ">" in tag:
                if rows:
                    rows[-1].append(tuple(max(1, int(m[1])) if (m := re.search(rf'{s}\s*=\s*["\']?(\d+)', tag)) else 1 for s in ("rowspan", "colspan")))
                tag = ""
        elif re.match(r"<tr(\s|>|$)", token):
            rows.append([])
    return rows


def annotated_cells(tokens: list[str], contents: int) -> tuple[list[Cell], int, int]:
    """(logical cells, rows, columns) of structure tokens, as far as there are contents: the cell without one ends the table."""
    kept, left = [], contents
    for row in token_rows(tokens):
        kept.append([(high, wide, "", False) for high, wide in row[:left]])
        left -= len(row)
        if left < 0:
            break
    cells = place(kept)
    return cells, len(kept), max((c.c1 for c in cells), default=0)


def fill_tokens(tokens: list[str], cells: list[str], strict: bool = False) -> str:
    """Structure tokens with a cell's text before each '</td>'; too few cells: empty ones, or an error if strict."""
    texts, out = iter(cells), []
    for token in tokens:
        if token == "</td>":
            try:
                out.append(next(texts))
            except StopIteration:
                if strict:
                    raise ValueError("fewer cells than places") from None
        out.append(token)
    return "".join(out)


def structure(markup: str | None) -> tuple[list[str], list[str]]:
    """Structure tokens and cell texts of the first table: head and body always stand, all cells are td, loose rows follow the body's."""
    table = first_table(markup)
    parts: dict[str, list] = {"thead": [], "tbody": []}
    loose = []
    for child in table.elements() if table else ():
        if child.tag == "tr":
            loose.append(child)
        elif child.tag in SECTIONS:
            parts["thead" if child.tag == "thead" else "tbody"] += [r for r in child.elements() if r.tag == "tr"]
    parts["tbody"] += loose
    tokens, texts = [], []
    for name, rows in parts.items():
        tokens.append(f"<{name}>")
        for row in rows:
            tokens.append("<tr>")
            for cell in (c for c in row.elements() if c.tag in CELLS):
                spans = [f' {s}="{cell.span(s)}"' for s in ("rowspan", "colspan") if cell.span(s) > 1]
                tokens += ["<td", *spans, ">", "</td>"] if spans else ["<td>", "</td>"]
                texts.append(" ".join(cell.text().split()))
            tokens.append("</tr>")
        tokens.append(f"</{name}>")
    return tokens, texts


def cells_markup(cells: list[Cell]) -> str:
    """Logical cells as markup; rows whose cells are all headers come first, in a head."""
    rows: dict[int, list[Cell]] = {}
    for cell in sorted(cells, key=lambda c: (c.r0, c.c0)):
        rows.setdefault(cell.r0, []).append(cell)
    head, body = [], []
    for r in sorted(rows):
        line = "".join(
            "<td" + (f' rowspan="{c.r1 - c.r0}"' if c.r1 - c.r0 > 1 else "") + (f' colspan="{c.c1 - c.c0}"' if c.c1 - c.c0 > 1 else "") + f">{escape(c.text, quote=False)}</td>" for c in rows[r]
        )
        (head if not body and all(c.header for c in rows[r]) else body).append(f"<tr>{line}</tr>")
    return "<table>" + (f"<thead>{''.join(head)}</thead>" if head else "") + f"<tbody>{''.join(body)}</tbody></table>"


OTSL_STARTS = ("fcel", "ecel", "ched", "rhed", "srow")


def otsl_cells(tokens: list[str]) -> list[Cell]:
    """Cells of OTSL tokens: starts begin a cell, lcel goes on to the right, ucel downwards, xcel both, nl ends a row; rows without a token are none, short ones are filled up."""
    grid = [list(row) for end, row in groupby(tokens, lambda t: t == "nl") if not end]
    wide = max(map(len, grid), default=0)
    grid = [row + ["ecel"] * (wide - len(row)) for row in grid]
    out = []
    for r, row in enumerate(grid):
        for c, token in enumerate(row):
            if token in OTSL_STARTS:
                c1, r1 = c + 1, r + 1
                while c1 < wide and row[c1] == "lcel":
                    c1 += 1
                while r1 < len(grid) and grid[r1][c] == "ucel":
                    r1 += 1
                out.append(Cell(r, r1, c, c1, "", token in ("ched", "rhed")))
    return out


def otsl_tokens(cells: list[Cell]) -> list[str]:
    """The inverse of otsl_cells, our own definition: a place that no cell holds is an empty cell."""
    rows, wide = max((c.r1 for c in cells), default=0), max((c.c1 for c in cells), default=0)
    grid = [["ecel"] * wide for _ in range(rows)]
    for cell in cells:
        for r in range(cell.r0, cell.r1):
            for c in range(cell.c0, cell.c1):
                first = "ched" if cell.header else "fcel"
                grid[r][c] = first if (r, c) == (cell.r0, cell.c0) else "lcel" if r == cell.r0 else "ucel" if c == cell.c0 else "xcel"
    return [t for row in grid for t in (*row, "nl")]


# Policies: named ways to make two tables comparable


def flattened(table: Node) -> Node:
    """All rows directly in the table, in document order."""
    return Node("table", dict(table.attrs), [row for row, _ in rows_of(table)])


def canonical(table: Node) -> Node:
    """Spans alone as attributes, th as td, line breaks as blanks, span and font unwrapped, blanks of leaf cells squashed."""

    def inside(node: Node) -> list:
        out: list = []
        for child in node.children:
            if isinstance(child, str):
                out.append(child)
            elif child.tag == "br":
                out.append(" ")
            elif child.tag in ("span", "font"):
                out += inside(child)
            else:
                out.append(changed(child))
        return out

    def changed(node: Node) -> Node:
        tag = "td" if node.tag == "th" else node.tag
        attrs = {k: v for k, v in node.attrs.items() if k in ("rowspan", "colspan")}
        children = inside(node)
        if tag == "td" and all(isinstance(c, str) for c in children):
            children = [" ".join("".join(children).split())]
        return Node(tag, attrs, children)

    return changed(table)


def comment_free_document(markup: str | None) -> str | None:
    """The first table alone, as a whole document without comments; null without a table."""
    table = first_table(markup)
    return as_document(table.markup()) if table else None


def tree_statistics(markup: str | None) -> dict:
    """Rows, cells, and cells that span rows, columns or either, of all of a document's tables."""
    nodes = list(parse(markup).walk())
    cells = [n for n in nodes if n.tag in CELLS]
    spans = [(c.span("rowspan") > 1, c.span("colspan") > 1) for c in cells]
    return {"rows": sum(n.tag == "tr" for n in nodes), "cells": len(cells), "rowspan_cells": sum(r for r, _ in spans), "colspan_cells": sum(c for _, c in spans), "span_cells": sum(map(any, spans))}


#: What a whole document of one table begins and ends with.
OPENING, CLOSING = "<html><body><table>", "</table></body></html>"


def whole_document(markup: str) -> str:
    """A table, or the inside of one, as a whole document."""
    if markup.startswith("<table>") and markup.endswith("</table>"):
        return f"<html><body>{markup}</body></html>"
    return markup if markup.startswith(OPENING) or markup.endswith(CLOSING) else f"{OPENING}{markup}{CLOSING}"


def _stripped_rows(part: str) -> str:
    """Rows with the texts of their cells, also inside a single b, without blanks at their ends. What stands between rows goes, and so does a second row that begins in an open one. Text that is in no cell is an error."""
    out = []
    for row in filter(None, part.split("</tr>")):
        begun = row.split("<tr>")
        cells = []
        for cell in filter(None, begun[min(1, len(begun) - 1)].split("</td>")):
            tag, end, text = cell.partition(">")
            if not end:
                raise ValueError(f"no cell begins before {cell[:20]!r}")
            bold = text.startswith("<b>") and text.endswith("</b>")
            cells.append(f"{tag}>" + (f"<b>{text[3:-4].strip()}</b>" if bold else text.strip()) + "</td>")
        out.append(f"<tr>{''.join(cells)}</tr>")
    return "".join(out)


def reassembled(document: str) -> str:
    """A document with one head and one body, cells stripped, put together from its text alone.

    Rows after the head's end are the body's, whether a body begins there or not. Without a head's end, what stands before the
    body is the head; without a body, everything is. Malformed rows raise ValueError.
    """
    before, found, rest = document.partition("<thead>")
    if not found:
        before, rest = OPENING, document[len(OPENING) :]
    head, found, tail = rest.partition("</thead>")
    if found:
        body = tail.removeprefix("<tbody>")
    elif "<tbody>" in rest:
        head, _, body = rest.partition("<tbody>")
    elif "</tbody>" in rest:
        head, _, after = rest.partition("</tbody>")
        body = f"</tbody>{after}"
    else:
        head, body = rest.split(CLOSING)[0], f"</tbody>{CLOSING}"
    inside, found, after = body.partition("</tbody>")
    if not found:
        inside, after = body.split(CLOSING)[0], CLOSING
    return f"{before}<thead>{_stripped_rows(head)}</thead><tbody>{_stripped_rows(inside)}</tbody>{after}"


def stripped(markup: str | None) -> Node | None:
    """The first table of a document put together anew."""
    return first_table(reassembled(whole_document(markup or "")))


def wrapped(table: Node) -> Node:
    """Loose rows after a head go into a body."""
    if not any(c.tag == "thead" for c in table.elements()):
        return table
    loose = [c for c in table.elements() if c.tag == "tr"]
    others = [c for c in table.children if not (isinstance(c, Node) and c.tag == "tr")]
    return Node("table", dict(table.attrs), [*others, Node("tbody", {}, loose)] if loose else others)


def prepared(markup: str | None, policy: str) -> Node | None:
    """The first table under a policy; None without a table."""
    if policy == "stripped":  # works on the text, before there is a tree
        return stripped(markup)
    table = first_table(markup)
    return POLICIES[policy](table) if table else None


_ROWS = "(?:<tr>(?:<td>(?:<b>[^<>&]*</b>|[^<>&]*)</td>)*+</tr>)*+"
#: A document of one table with a head and a body of plainly written cells, and a table with such a head and rows behind it: their trees' markup is the text itself.
_SECTIONED = re.compile(f"<html><body>(<table><thead>{_ROWS}</thead><tbody>{_ROWS}</tbody></table>)</body></html>")
_LOOSE = re.compile(f"<table>(<thead>{_ROWS}</thead>)({_ROWS})</table>")


def under_policy(markup: str | None, policy: str) -> str | None:
    """The first table's markup under a policy; null without a table."""
    if policy == "stripped":
        document = reassembled(whole_document(markup or ""))
        if plain := _SECTIONED.fullmatch(document):
            return plain[1]
        table = first_table(document)
        return table.markup() if table else None
    if policy == "wrapped" and markup and (plain := _LOOSE.fullmatch(markup)):
        return f"<table>{plain[1]}<tbody>{plain[2]}</tbody></table>" if plain[2] else markup
    table = prepared(markup, policy)
    return table.markup() if table else None


POLICIES: dict[str, Callable[[Node], Node]] = {"none": lambda t: t, "flattened": flattened, "canonical": canonical, "stripped": lambda t: t, "wrapped": wrapped}


# Tree edit similarity


Tree = tuple[tuple, tuple]


def shape(node: Node, structure_only: bool = False) -> Tree:
    """A node as ((tag, spans, content), children); a cell is a leaf that holds its content."""
    if node.tag in CELLS:
        return (node.tag, node.span("rowspan"), node.span("colspan"), () if structure_only else tuple(content_tokens(node))), ()
    return (node.tag, 1, 1, ()), tuple(shape(c, structure_only) for c in node.elements())


def bared(tree: Tree) -> Tree:
    """A shape without contents."""
    return (*tree[0][:3], ()), tuple(map(bared, tree[1]))


def unlike(a: Tree, b: Tree) -> tuple[tuple, tuple]:
    """The forests whose distance is that of two trees with equal roots: equal trees at either end cost nothing, and equal roots of what is left are taken off in turn."""
    x, y = a[1], b[1]
    while True:
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        x, y = x[n:], y[n:]
        n = 0
        while n < min(len(x), len(y)) and x[-1 - n] == y[-1 - n]:
            n += 1
        x, y = x[: len(x) - n], y[: len(y) - n]
        if not (len(x) == len(y) == 1 and x[0][0] == y[0][0] and x[0][0][0] not in CELLS):
            return x, y
        x, y = x[0][1], y[0][1]


def _postorder(forest: tuple) -> tuple[list[tuple], list[int], list[int]]:
    """Labels, leftmost leaves and key roots of a forest below a common root."""
    labels, leftmost = [], []

    def visit(label: tuple, children: tuple) -> int:
        first = None
        for child in children:
            at = visit(*child)
            first = leftmost[at] if first is None else first
        labels.append(label)
        leftmost.append(len(labels) - 1 if first is None else first)
        return len(labels) - 1

    visit(("forest", 1, 1, ()), forest)
    last: dict[int, int] = {leaf: k for k, leaf in enumerate(leftmost)}
    return labels, leftmost, sorted(last.values())


def content_tokens(cell: Node) -> list[str]:
    """A cell's content as characters and inner tags."""
    out: list[str] = []
    for child in cell.children:
        if isinstance(child, str):
            out += list(child)
        else:
            out += [f"<{child.tag}>", *content_tokens(child), f"</{child.tag}>"]
    return out


def tree_distance(a: Node, b: Node, structure_only: bool = False) -> float:
    """The ordered tree edit distance: 1 to insert or delete, 1 to rename a tag or change a span, else the normalised edit distance of the contents."""
    return shape_distance(shape(a, structure_only), shape(b, structure_only))


def renaming(a: tuple) -> Callable[[tuple], float]:
    """What it costs to rename one node into others: 1, or the normalised distance of the contents of equal cells."""
    kind, items = a[:3], a[3]
    pattern = trees.Pattern(items)

    def cost(b: tuple) -> float:
        if kind != b[:3]:
            return 1.0
        return pattern.distance(b[3]) / max(len(items), len(b[3]), 1) if items != b[3] else 0.0

    return cost


#: Pairs of nodes from which on rows of arrays are the quicker way to the same distance.
SMALL = 2_000


def shape_distance(a: Tree, b: Tree) -> float:
    """The distance of two shapes; what is equal at their ends is left out first."""
    x, y = unlike(a, b) if a[0] == b[0] else ((a,), (b,))
    if not x or not y:
        return float(sum(map(weight, x or y)))
    if len(x) == len(y) == 1 and not x[0][1] and not y[0][1]:
        return float(renaming(x[0][0])(y[0][0]))
    if weight(("", x)) * weight(("", y)) > SMALL:
        return trees.forest_distance(x, y, renaming)
    la, left_a, keys_a = _postorder(x)
    lb, left_b, keys_b = _postorder(y)
    # a mapping keeps the postorder: one that leaves the band has at least two more nodes without a partner for each diagonal outside
    d, extra = abs(len(la) - len(lb)), 0
    while (found := _banded_distance(la, left_a, keys_a, lb, left_b, keys_b, extra)) > d + 2 * (extra + 1):
        extra = int(found - d) // 2 if found < _NEVER else 2 * extra + 1
    return found


_NEVER = float("inf")


@lru_cache(1 << 14)
def _renamed(a: tuple, b: tuple) -> float:
    return float(renaming(a)(b))


def _banded_distance(la: list[tuple], left_a: list[int], keys_a: list[int], lb: list[tuple], left_b: list[int], keys_b: list[int], extra: int) -> float:
    """The least cost of the mappings between two forests in postorder that stay on the diagonals between their corners and so many more on both sides."""
    low, high = min(0, len(lb) - len(la)) - extra, max(0, len(lb) - len(la)) + extra
    whole = [[_NEVER] * len(lb) for _ in la]
    for i in keys_a:
        io = left_a[i]
        for j in keys_b:
            jo = left_b[j]
            if not low <= jo - io <= high:
                continue
            width, shift = j - jo + 2, 1 - jo
            forest = [[float(y) if y <= high + io - jo else _NEVER for y in range(width)]]
            for p in range(io, i + 1):
                above, row = forest[-1], [_NEVER] * width
                forest.append(row)
                y, end = p + low + shift, min(width, p + high + shift + 1)
                value = _NEVER
                if y <= 0:
                    row[0] = value = above[0] + 1
                    y = 1
                if y >= end:
                    continue
                start, trees_, label = forest[left_a[p] - io], whole[p], la[p]
                on_path = left_a[p] == io
                for y in range(y, end):
                    q = y - shift
                    first = left_b[q] + shift - 1
                    if above[y] < value:
                        value = above[y]
                    value += 1
                    if on_path and not first:
                        other = above[y - 1] if label == lb[q] else above[y - 1] + _renamed(label, lb[q])
                        trees_[q] = value = other if other < value else value
                    else:
                        other = start[first] + trees_[q]
                        value = other if other < value else value
                    row[y] = value
    return whole[-1][-1]


def weight(tree: Tree) -> int:
    return 1 + sum(map(weight, tree[1]))


def similarities(pred: str | None, true: str | None, policy: str = "none", ignore: tuple[str, ...] = ()) -> tuple[float, float, str | None]:
    """(structure score, score, error): 1 less the distance over the larger tree's inner nodes, which is below 0 where there are more steps than nodes. What fails scores 0 and says why. Elements named in `ignore` are taken out of their contents for the second score, before its nodes are counted."""
    try:
        if policy != "stripped" and not ignore and (y := _plain_rows(true)) is not None:
            if not pred:
                return 0.0, 0.0, "no table"
            if (x := _plain_rows(pred)) is not None and (policy != "canonical" or _squashed(pred) and _squashed(true)):
                return *_plain_scores(x, y), None
        if pred and pred == true and first_table(pred):
            return 1.0, 1.0, None
        a, b = prepared(pred, policy), prepared(true, policy)
        if a is None or b is None:
            return 0.0, 0.0, "no table"
        bare = score(bared(shape(a)), bared(shape(b)), a, b)
        if ignore:
            a, b = a.without(ignore), b.without(ignore)
        return bare, score(shape(a), shape(b), a, b), None
    except (RecursionError, ValueError, KeyError) as why:
        return 0.0, 0.0, f"{type(why).__name__}: {why}"


_TABLE, _TR, _TD = ("table", 1, 1, ()), ("tr", 1, 1, ()), ("td", 1, 1, ())


def _rows_distance(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """The distance of two tables of rows of so many cells without contents."""
    return shape_distance(*((_TABLE, tuple((_TR, ((_TD, ()),) * n) for n in rows)) for rows in (a, b)))


#: Short tables have few shapes.
_known_rows_distance = lru_cache(1 << 14)(_rows_distance)


def _plain_scores(x: list[str], y: list[str]) -> tuple[float, float]:
    """Both scores of two tables of plain cells by their rows: equal rows at either end cost nothing and are not made into trees."""
    a, b = ([row.count("</td>") for row in rows] for rows in (x, y))
    size = max(len(a) + sum(a), len(b) + sum(b))
    if x == y or not size:
        return 1.0, 1.0
    bare, other = _unlike_ends(a, b)
    far = (_known_rows_distance if len(bare) + len(other) <= 64 else _rows_distance)(tuple(bare), tuple(other))
    trees_ = ((_TABLE, tuple((_TR, tuple(((*_TD[:3], tuple(text[len("<td>") :])), ()) for text in row[len("<tr>") :].split("</td>")[:-1])) for row in rows)) for rows in _unlike_ends(x, y))
    return 1.0 - far / size, 1.0 - shape_distance(*trees_) / size


def _unlike_ends(x: list, y: list) -> tuple[list, list]:
    """What is left of two lists without equal members at either end."""
    n, least = 0, min(len(x), len(y))
    while n < least and x[n] == y[n]:
        n += 1
    m = 0
    while m < least - n and x[-1 - m] == y[-1 - m]:
        m += 1
    return x[n : len(x) - m], y[n : len(y) - m]


def score(x: Tree, y: Tree, a: Node, b: Node) -> float:
    size = max(a.size(), b.size()) - 1
    return 1.0 - shape_distance(x, y) / size if size else 1.0


def similarity(pred: str | None, true: str | None, policy: str = "none", structure_only: bool = False, ignore: tuple[str, ...] = ()) -> tuple[float, str | None]:
    """(score, error) of one of the two scores."""
    s, t, error = similarities(pred, true, policy, ignore)
    return s if structure_only else t, error
