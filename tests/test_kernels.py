"""Golden cases and properties of the pure kernels."""

from __future__ import annotations

import itertools
import random
import re
import time
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.functions import align as A
from tablescope.functions import diffs as D
from tablescope.functions import markup as M
from tablescope.functions import structure as S
from tablescope.functions import text as T
from tablescope.functions import trees
from tablescope.operators.boxes import running_clusters


def test_attribute_order_does_not_matter_and_spans_do():
    a, b = '<table><tr><td colspan="2" rowspan="2">A</td></tr></table>', '<table><tr><td rowspan="2" colspan="2">A</td></tr></table>'
    c = '<table><tr><td colspan="2">A</td></tr></table>'
    assert M.similarity(a, b) == (1.0, None)
    assert M.similarity(a, b, structure_only=True)[0] == 1.0
    assert M.similarity(a, c)[0] < 1 and M.similarity(a, c, structure_only=True)[0] < 1


def test_grid_with_a_span_from_above():
    cells = M.logical_cells("<table><tr><td rowspan=2>A</td><td>B</td></tr><tr><td>C</td></tr></table>")
    assert [(c.text, c.r0, c.c0) for c in cells] == [("A", 0, 0), ("B", 0, 1), ("C", 1, 1)]
    assert M.logical_cells("<p>no table</p>") == [] == M.logical_cells(None)


def test_ends_read_in_the_wrong_mode():
    right, wrong = M.ended([(0, 1, 0, 1)], "exclusive")[0], M.ended([(0, 1, 0, 1)], "compat")[0]
    assert M.cell_iou(right, M.Cell(0, 1, 0, 1)) == 1.0
    assert M.cell_iou(wrong, M.Cell(0, 1, 0, 1)) == 0.25
    assert M.ended([(0, 0, 0, 0)], "inclusive")[0] == M.Cell(0, 1, 0, 1)


def test_matching():
    assert M.greedy_match([(1.0, 0, 0), (1.0, 1, 0)]) == [(1, 0)]
    assert M.greedy_match([(0.4, 0, 0)]) == []
    assert M.match_scores(0, 0, 0) == (1.0, 1.0, 1.0)
    assert M.match_scores(2, 0, 0) == (0.0, 0.0, 0.0)


def test_otsl():
    assert [(c.r0, c.r1, c.c0, c.c1) for c in M.otsl_cells("fcel lcel nl fcel fcel nl".split())] == [(0, 1, 0, 2), (1, 2, 0, 1), (1, 2, 1, 2)]
    assert M.otsl_cells("fcel fcel nl ucel fcel nl".split())[0].r1 == 2


def test_shapes_of_whole_and_split_tags():
    assert M.table_shape(["<tr>", "<td>", "</td>", "<td", ' colspan="3"', ">", "</td>", "</tr>"]) == (1, 4)
    assert M.table_shape(["<tr>", "<td>", "</td>", "</tr>", "<tr>", "<td>", "</td>", "<td>", "</td>", "</tr>"]) == (2, 2)


def test_fill_tokens():
    assert M.fill_tokens(["<td>", "</td>", "<td>", "</td>"], ["x"]) == "<td>x</td><td></td>"
    try:
        M.fill_tokens(["</td>"], [], strict=True)
        raise AssertionError("no error")
    except ValueError:
        pass


def test_structure_always_has_head_and_body():
    tokens, texts = M.structure('<table><tr><th colspan="x">a</th></tr></table>')
    assert tokens == ["<thead>", "</thead>", "<tbody>", "<tr>", "<td>", "</td>", "</tr>", "</tbody>"] and texts == ["a"]


def test_policies():
    loose = "<table><thead><tr><th>a</th></tr></thead><tr><td>b <br> c</td></tr></table>"
    table = M.first_table(loose)
    assert "<tbody><tr>" in M.wrapped(table).markup()
    assert [n.tag for n in M.flattened(table).elements()] == ["tr", "tr"]
    assert "<td>b c</td>" in M.canonical(table).markup() and "<th" not in M.canonical(table).markup().replace("<thead", "")
    assert "<td><b>x</b></td>" in M.prepared("<table><tr><td><b> x </b></td></tr></table>", "stripped").markup()
    assert M.similarity(loose, loose.replace("thead>", "tbody>"), "flattened")[0] > M.similarity(loose, loose.replace("thead>", "tbody>"), "none")[0]


def test_failures_score_zero_and_say_why():
    assert M.similarity("<p>", "<table><tr><td>a</td></tr></table>") == (0.0, "no table")
    assert M.similarity(None, None)[0] == 0.0


def test_alignment():
    found, left, value = A.align(["ab cd"], ["ab", "cd"])
    assert found == {0: (0, 2, 1.0)} and left == 0 and abs(value - 1.255) < 1e-12
    assert A.align([], ["x"])[1] == 1 and A.align(["a"], [])[0] == {}
    assert A.judge(["ab"], [])["reason"] == "no_regions"
    assert A.gold_coordinate("t", [(1, 2, 3, 4), (0, 3, 2, 9)]) == "0.00 2.00 3.00 9.00 2 t"
    assert A.gold_coordinate("", [(1, 2, 3, 4)]) == "-1.0 -1.0 -1.0 -1.0 1 "


def test_text_kernels():
    assert T.normalise(" ﬁ­x \n y") == "fi x y".replace("fi x", "fix")
    assert T.compact("Straße A") == "strassea"
    assert T.alignment_key("A–1 b!") == "a1b"
    assert T.ratio_similarity("", "") == 1.0 and T.indel_similarity("", "") == 0.0
    same = T.text_metrics("a b", "a b")
    assert same["exact"] and same["wer"] == 0 and abs(same["token_f1"] - 1) < 1e-9
    assert T.text_metrics("", "")["char_similarity"] == 1.0 and T.text_metrics(None, "x")["cer"] == 1.0


def test_running_clusters():
    assert running_clusters([0, 1, 5, 5.5], 2) == [0, 0, 1, 1]


# Properties

cell = st.tuples(st.integers(1, 2), st.integers(1, 2), st.text("ab <&", max_size=3))
grids = st.lists(st.lists(cell, min_size=1, max_size=3), min_size=1, max_size=3)


def html(rows) -> str:
    return "<table>" + "".join("<tr>" + "".join(f'<td rowspan="{r}" colspan="{c}">{t.replace("&", "&amp;").replace("<", "&lt;")}</td>' for r, c, t in row) + "</tr>" for row in rows) + "</table>"


@settings(max_examples=60, deadline=None)
@given(grids, grids)
def test_tree_distance_is_symmetric_and_zero_for_equals(a, b):
    x, y = M.first_table(html(a)), M.first_table(html(b))
    assert M.tree_distance(x, x) == 0
    assert abs(M.tree_distance(x, y) - M.tree_distance(y, x)) < 1e-9
    assert -1 <= M.similarity(html(a), html(b))[0] <= 1


def test_similarity_is_not_cut_off_at_zero():
    """Five steps between trees of four inner nodes: a cell renamed, a row and its cell deleted, two cells inserted."""
    assert M.similarity(html([[(1, 1, "")], [(1, 1, "")]]), html([[(1, 2, "")] * 3]))[0] == -0.25


def brute_distance(a, b) -> float:
    """The forest recursion as published, without any order of evaluation."""
    from functools import cache

    def forest(n):
        inner = () if n.tag in M.CELLS else tuple(forest(c) for c in n.elements())
        text = tuple(M.content_tokens(n)) if n.tag in M.CELLS else ()
        return ((n.tag, n.span("rowspan"), n.span("colspan")) if n.tag in M.CELLS else (n.tag, 1, 1), text, inner)

    def size(f):
        return sum(1 + size(t[2]) for t in f)

    @cache
    def d(f, g):
        if not f or not g:
            return float(size(f) + size(g))
        (v, vt, vc), (w, wt, wc) = f[-1], g[-1]
        rename = 1.0 if v != w else 0.0 if vt == wt else T.distance(vt, wt) / max(len(vt), len(wt), 1)
        return min(d(f[:-1] + vc, g) + 1, d(f, g[:-1] + wc) + 1, d(f[:-1], g[:-1]) + d(vc, wc) + rename)

    return d((forest(a),), (forest(b),))


@settings(max_examples=40, deadline=None)
@given(grids, grids)
def test_tree_distance_equals_brute_force(a, b):
    x, y = M.first_table(html(a)), M.first_table(html(b))
    assert abs(M.tree_distance(x, y) - brute_distance(x, y)) < 1e-9


@settings(max_examples=60, deadline=None)
@given(grids)
def test_otsl_and_markup_round_trips(rows):
    cells = M.logical_cells(html(rows))
    places = [(r, c) for x in cells for r in range(x.r0, x.r1) for c in range(x.c0, x.c1)]
    if len(places) == len(set(places)):  # spans that run into each other have no OTSL
        kept = {(x.r0, x.r1, x.c0, x.c1) for x in cells}
        assert kept <= {(x.r0, x.r1, x.c0, x.c1) for x in M.otsl_cells(M.otsl_tokens(cells))}


@settings(max_examples=80, deadline=None)
@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_subsequence_and_distance(a, b):
    best = max(len(s) for n in range(len(a) + 1) for s in map("".join, itertools.combinations(a, n)) if all(c in it for it in [iter(b)] for c in s))
    assert T.common_subsequence(a, b) == best
    assert T.distance(a, b) == T.distance(b, a) <= max(len(a), len(b))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=3), max_size=3), st.lists(st.text("ab", min_size=1, max_size=3), max_size=4))
def test_alignment_is_the_best_path(cells, regions):
    def best(i, j):
        if i == len(cells) and j == len(regions):
            return 0.0
        out = [best(i, j + 1) - A.SKIP_REGION] if j < len(regions) else []
        if i < len(cells):
            out.append(best(i + 1, j) - A.SKIP_CELL)
            out += [2 * T.indel_similarity(cells[i], "".join(regions[j : j + k])) - A.MAPPED - A.FURTHER * (k - 1) + best(i + 1, j + k) for k in range(1, len(regions) - j + 1)]
        return max(out)

    assert abs(A.align(cells, regions)[2] - best(0, 0)) < 1e-9


# Trees of any size


def random_tree(rng: random.Random, n: int, depth: int = 4) -> M.Node:
    """A table-like tree of n nodes, inner tags among the contents of its cells."""
    root = M.Node("table")
    inner = [(root, 0)]
    for _ in range(n):
        parent, d = rng.choice(inner[-3:] if rng.random() < 0.7 else inner)
        if rng.random() < 0.6 or d >= depth:
            cell = M.Node("td", {"colspan": "2"} if rng.random() < 0.2 else {}, [rng.choice(["a", "ab", "abc", "xyz", ""])])
            if rng.random() < 0.3:
                cell.children.append(M.Node("b", {}, [rng.choice("pq")]))
            parent.children.append(cell)
        else:
            child = M.Node(rng.choice(["tr", "tbody", "div"]))
            parent.children.append(child)
            inner.append((child, d + 1))
    return root


@pytest.mark.parametrize("seed", range(40))
def test_arrays_have_the_distance_of_lists(seed, monkeypatch):
    """The same trees by rows of arrays and by lists, and small ones by brute force."""
    rng = random.Random(seed)
    n = rng.choice((3, 8, 30, 60))
    a, b = (M.shape(random_tree(rng, rng.randint(0, n))) for _ in range(2))
    monkeypatch.setattr(M, "SMALL", 1 << 40)
    want = M.shape_distance(a, b)
    monkeypatch.setattr(M, "SMALL", 0)
    assert abs(M.shape_distance(a, b) - want) < 1e-9
    monkeypatch.setattr(trees, "KEPT", 0)
    assert abs(M.shape_distance(b, a) - want) < 1e-9


def test_long_chains_and_wide_trees(monkeypatch):
    """Paths to the left and to the right, and a row of leaves: one side each of both decompositions."""

    def chain(n: int, left: bool) -> tuple:
        tree = (("x", 1, 1, ()), ())
        for k in range(n):
            leaf = (("td", 1, 1, (str(k),)), ())
            tree = ((f"t{k % 3}", 1, 1, ()), (tree, leaf) if left else (leaf, tree))
        return tree

    wide = (("x", 1, 1, ()), tuple((("td", 1, 1, (str(k % 7),)), ()) for k in range(50)))
    every = [chain(30, True), chain(30, False), chain(9, True), wide]
    for x in every:
        for y in every:
            monkeypatch.setattr(M, "SMALL", 1 << 40)
            want = M.shape_distance(x, y)
            monkeypatch.setattr(M, "SMALL", 0)
            assert abs(M.shape_distance(x, y) - want) < 1e-9


def test_bits_have_the_distance_of_rows():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert trees.Pattern(a).distance(b) == T.distance(a, b)


def large_table(rows: int, shift: int = 0) -> str:
    cell = lambda r, c: f"<td>{(r * 7 + c * 3 + shift * (r % 5 == 0)) % 1000}</td>"
    return "<table>" + "".join("<tr>" + "".join(cell(r, c) for c in range(4)) + "</tr>" for r in range(rows) if (r + shift) % 11) + "</table>"


def test_tables_of_thousands_of_nodes_are_scored():
    """4,000 nodes a side, nothing left out, in bounded memory."""
    tracemalloc.start()
    s, t, error = M.similarities(large_table(800), large_table(800, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert error is None and 0.8 < s <= 1 and 0.3 < t < s
    assert peak < 400 << 20


def test_ignored_nodes_are_taken_out_of_the_second_score():
    bold, plain = "<table><tr><td><b>x</b> y</td></tr></table>", "<table><tr><td>x y</td></tr></table>"
    assert M.similarities(bold, plain)[1] < 1
    s, t, _ = M.similarities(bold, plain, ignore=("b",))
    assert t == 1 and s == 1
    inside = M.parse("<p><b>a<i>c<b>d</b></i></b>e</p>").without(("b",))
    assert inside.markup() == "<document><p>a<i>cd</i>e</p></document>"
    # nodes are counted after that: two of three inner nodes are left, and one is changed
    assert abs(M.similarities("<table><tr><td><b>x</b></td></tr></table>", "<table><tr><td>y</td></tr></table>", ignore=("b",))[1] - (1 - 1 / 2)) < 1e-12


@pytest.mark.parametrize("seed", range(30))
def test_the_quick_parser_is_the_librarys(seed, monkeypatch):
    rng = random.Random(seed)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<TH Colspan=\"2\">", "</th>", "<td rowspan='3' class=\"a b\">", "<br>", "<br/>", "<img src=\"x\" />", "a &amp; b", "x < y", "&lt;", " ", "<thead>", "<tbody>", "</b >", "<b>", "<td colspan=2>", "<!-- c -->", "<script>a<b</script>", "<td hidden>", "&nbsp", "</td x>", "<p/ >", "é"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        quick = M.parse(text).markup()
        with monkeypatch.context() as m:
            m.setattr(M, "_plain_tree", lambda _: None)
            assert quick == M.parse(text).markup(), text


# The reassembled document, a case for each branch


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<table><thead><tr><td> a </td></tr></thead><tbody><tr><td><b> b </b></td></tr></tbody></table>", "<thead><tr><td>a</td></tr></thead><tbody><tr><td><b>b</b></td></tr></tbody>"),
        ("<table><thead><tr><td>a</td></tr></thead><tr><td> b</td></tr></table>", "<thead><tr><td>a</td></tr></thead><tbody><tr><td>b</td></tr></tbody>"),
        ("<table><thead><tr><td>a</td></tr><tbody><tr><td>b</td></tr></tbody></table>", "<thead><tr><td>a</td></tr></thead><tbody><tr><td>b</td></tr></tbody>"),
        ("<table><tr><td>a</td></tr><tbody><tr><td>b</td></tr></tbody></table>", "<thead><tr><td>a</td></tr></thead><tbody><tr><td>b</td></tr></tbody>"),
        ("<table><tr><td>a</td></tr></tbody></table>", "<thead><tr><td>a</td></tr></thead><tbody></tbody>"),
        ("<table><tr><td> a</td></tr></table>", "<thead><tr><td>a</td></tr></thead><tbody></tbody>"),
        ("<table></table>", "<thead></thead><tbody></tbody>"),
        ("<tr><td>a</td></tr>", "<thead><tr><td>a</td></tr></thead><tbody></tbody>"),
        ("<table><thead></thead><tbody><td> a</td></table>", "<thead></thead><tbody><tr><td>a</td></tr></tbody>"),
        ('<table><thead><tr><td colspan="2"> a b </td><td></td></tr></thead><tbody></tbody></table>', '<thead><tr><td colspan="2">a b</td><td></td></tr></thead><tbody></tbody>'),
    ],
)
def test_reassembled(given, want):
    assert M.reassembled(M.whole_document(given)) == f"<html><body><table>{want}</table></body></html>"


@pytest.mark.parametrize("broken", ["<table><thead>loose</thead></table>", "<table><tr> <td>a</td></tr>\n</table>", "<table><tbody>x</tr></tbody></table>"])
def test_malformed_rows_are_errors(broken):
    with pytest.raises(ValueError, match="no cell"):
        M.reassembled(M.whole_document(broken))
    assert M.similarities(broken, "<table><tr><td>a</td></tr></table>", "stripped")[:2] == (0.0, 0.0)


def test_texts_by_row():
    assert S.otsl_markup_by_row(["fcel", "lcel", "nl", "nl", "fcel", "ecel"], [["a"], ["b", "c"]]) == '<tr><td colspan="2">a</td></tr><tr><td>b</td><td>c</td></tr>'
    for rows in ([["a"]], [["a"], ["b"]], [["a", "x"], ["b"]], [["a"], ["b", "c"], []]):
        with pytest.raises(ValueError, match="row"):
            S.otsl_markup_by_row(["fcel", "lcel", "nl", "fcel", "ecel"], rows)


@pytest.mark.parametrize("seed", range(25))
def test_clusters_are_the_best_cuts(seed):
    """Against all ways to cut the different positions."""
    rng = random.Random(seed)
    x = [rng.randint(0, 30) for _ in range(rng.randint(1, 11))]
    k, some = rng.randint(1, 5), sorted(set(x))
    spread = lambda part: sum((v - sum(part) / len(part)) ** 2 for v in part)
    got = D.centres([float(v) for v in x], k)
    assert len(got) == k and got == sorted(got)
    if len(some) > k:
        every = lambda a, b: [v for v in x if some[a] <= v <= some[b - 1]]
        cuts = [(0, *c, len(some)) for c in itertools.combinations(range(1, len(some)), k - 1)]
        best = min(sum(spread(every(a, b)) for a, b in itertools.pairwise(c)) for c in cuts)
        mine = sum(min((v - c) ** 2 for c in got) for v in x)
        assert mine <= best + 1e-9
    counted = {v: x.count(v) for v in some}
    assert D.centres(list(map(float, counted)), k, list(counted.values())) == pytest.approx(got)


def test_alignments_of_many_tables_are_those_of_each():
    """Tables of all sizes at once, with empty, long and strange texts; a table takes less than a millisecond where there are many alike."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcABé-中 1") for _ in range(rng.choice((0, 1, 2, 3, 5, 9, 70 if rng.random() < 0.1 else 4))))
    odd = [([word() for _ in range(rng.randint(0, 7))], [word() for _ in range(rng.randint(0, 11))]) for _ in range(150)]
    odd += [(cells, ["".join(cells)[:7], *cells[::-1], *cells]) for cells, _ in odd[:50]]
    assert A.align_all([]) == [] and A.align_all(odd) == [A.align(*x) for x in odd]
    assert A.judge_all(odd) == [A.judge(*x) for x in odd]
    plain = [[t for k in range(4) for t in (str(rng.randrange(20_000)), rng.choice("ANR"), rng.choice("FO"))] for _ in range(1500)]
    begun = time.perf_counter()
    assert {x["reason"] for x in A.judge_all([(x, x) for x in plain])} == {"accepted"}
    assert time.perf_counter() - begun < 3


def test_plain_markup_is_read_once_and_by_one_pattern(monkeypatch):
    """Comments are plain markup, regular tables need no tree, and no kernel parses its input twice; all equal to the library parser's."""

    def library(text: str) -> M.Node:
        builder = M._Builder()
        builder.feed(text)
        builder.close()
        return builder.tree.open[0]

    for text in ("<p>a</p><!-- c --><table><tr><td>1</td></tr><!----></table>", "<!--x-y--><table></table>", "<table><!--> --></table>", "<table><tr><td>a<!-- b -->c</td></tr></table>"):
        assert M.parse(text) == library(text)
    assert M._plain_tree("<table><tr><td>a<!-- b -->c</td></tr></table>") is not None
    regular = ["<table></table>", "<table><tr></tr></table>", "<table><tr><td></td><td> a  b\n</td></tr><tr><td>é</td></tr></table>"]
    other = ["<table><tr><td>a</td></tr></table> ", "<table><tr><td>&lt;</td></tr></table>", "<table><tr><td>a</td></table>", "<table><tr><td><b>a</b></td></tr></table>"]
    for text in regular + other:
        rows = [[(1, 1, " ".join(c.text().split()), False) for c in row.elements()] for row in library(text).children[0].elements()]
        assert M.logical_cells(text) == M.logical_cells(text, True) == M.place(rows)
    parsed = []
    whole = M.parse
    monkeypatch.setattr(M, "parse", lambda text: parsed.append(text) or whole(text))
    assert M.logical_cells(regular[2]) and not parsed
    assert M.tree_statistics(other[3])["cells"] == 1 and len(parsed) == 1
    assert S.difference_callouts(other[3], other[2]) == ["markup"] and len(parsed) == 3


def plain_table(rows: list[list[str]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"


def test_plain_tables_are_scored_without_a_parser(monkeypatch):
    """Equal rows at the ends of plain tables are found in the text; the scores are those of the parsed trees."""
    rng = random.Random(11)
    made = [plain_table([[rng.choice(("", "1", "12", "a>b", " é ", "xyz")) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 5))]) for _ in range(60)]
    pairs = [(rng.choice(made), rng.choice(made)) for _ in range(300)] + [(None, made[0]), ("", made[1]), (made[2], made[2])]
    with monkeypatch.context() as m:
        m.setattr(M, "_plain_rows", lambda _: None)
        want = [M.similarities(*p) for p in pairs]
    assert [M.similarities(*p) for p in pairs] == want
    monkeypatch.setattr(M, "parse", None)
    assert [M.similarities(*p) for p in pairs] == want


def test_plain_policies_are_texts(monkeypatch):
    """A table that is plainly written as its policy wants it is not parsed; others give what their trees give."""
    head, row = "<thead><tr><td>a</td><td><b>b</b></td></tr></thead>", "<tr><td>1</td><td></td></tr>"
    known = {("wrapped", f"<table>{head}{row}{row}</table>"): f"<table>{head}<tbody>{row}{row}</tbody></table>", ("wrapped", f"<table>{head}</table>"): f"<table>{head}</table>", ("stripped", "<table><tr><td> <b> x </b></td><td> y </td></tr></table>"): "<table><thead><tr><td><b> x </b></td><td>y</td></tr></thead><tbody></tbody></table>"}
    others = [("wrapped", f"<table>{head}<tr><td>a>b</td></tr></table>"), ("wrapped", f"<table>{head}<tr><th>x</th></tr></table>"), ("wrapped", f"<table>{row}</table>"), ("wrapped", None), ("stripped", None), ("stripped", "<table><tr><td>&lt;</td></tr></table>")]
    never = re.compile("(?!)")
    with monkeypatch.context() as m:
        m.setattr(M, "_SECTIONED", never)
        m.setattr(M, "_LOOSE", never)
        want = {(policy, text): M.under_policy(text, policy) for policy, text in [*known, *others]}
    assert {(policy, text): M.under_policy(text, policy) for policy, text in [*known, *others]} == want
    monkeypatch.setattr(M, "parse", None)
    for (policy, text), made in known.items():
        assert M.under_policy(text, policy) == made == want[policy, text]


@pytest.mark.parametrize("policy", ["canonical", "flattened", "wrapped"])
def test_plain_tables_under_policies_are_scored_without_a_parser(monkeypatch, policy):
    rng = random.Random(12)
    made = [plain_table([[rng.choice(("", "1", "1 2", "xyz")) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 5))]) for _ in range(40)]
    pairs = [(rng.choice(made), rng.choice(made)) for _ in range(150)]
    blanks = [(plain_table([[" a  b", "c"]]), plain_table([["a b", "c "]])), (plain_table([["a\u00a0 b"]]), plain_table([["a b"], []]))]
    with monkeypatch.context() as m:
        m.setattr(M, "_plain_rows", lambda _: None)
        want = [M.similarities(*p, policy) for p in [*pairs, *blanks]]
    assert [M.similarities(*p, policy) for p in [*pairs, *blanks]] == want
    monkeypatch.setattr(M, "parse", None)
    assert [M.similarities(*p, policy) for p in pairs] == want[: len(pairs)]


@given(st.text("abé\U0001f600", max_size=9), st.text("abé\U0001f600", max_size=9))
def test_text_distance_equals_its_definition(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    assert trees.text_distance(a, b) == row[-1]
    assert trees.text_distance(None, b) is trees.text_distance(a, None) is None


def test_equal_structures_are_read_once(monkeypatch):
    """q73: the places of annotations are those of each one alone, and a structure that many tables have is parsed once."""
    import pyarrow as pa
    from tablescope.operators import tables

    row = ["<tr>", "<td>", "</td>", "<td", ' colspan="2"', ">", "</td>", "</tr>"]
    some = [row * 2, ["<t", "r>"], [], row * 2, ["<tr>", "<td></td>"], row * 3, ["", *row * 2], row * 2] * 3
    contents = [4, 0, 0, 4, 1, 5, 4, 3] * 3
    want = [[{"r0": c.r0, "r1": c.r1, "c0": c.c0, "c1": c.c1} for c in M.annotated_cells(t, n)[0]] for t, n in zip(some, contents, strict=True)]
    calls, kernel = [], M.annotated_cells
    monkeypatch.setattr(M, "annotated_cells", lambda t, n: calls.append(n) or kernel(t, n))
    tokens, n = pa.array(some, pa.list_(pa.string())), pa.array(contents, pa.int32())
    assert tables.annotation_places(tokens, n).to_pylist() == want and len(calls) == 7
    assert tables.annotation_places(tokens.slice(5, 9), n.slice(5, 9)).to_pylist() == want[5:14]
    assert tables.annotation_places(tokens.slice(0, 0), n.slice(0, 0)).to_pylist() == []
    assert tables.annotation_places(pa.array([[]], pa.list_(pa.string())), n.slice(0, 1)).to_pylist() == [[]]


@pytest.mark.parametrize("text", [None, "", "x", "<table></table>", "<table><tr></tr><tr><td> a  b </td><td></td></tr><tr></tr></table>", "<table><tr><td rowspan=3>a</td><th>b</th></tr></table>", "<table><tr><td>a&amp;b</td></tr></table>"])
def test_cell_texts_are_those_of_the_cells(text):
    cells = M.logical_cells(text)
    assert M.cell_texts(text) == (max((c.r1 for c in cells), default=0), [c.text for c in cells])


def test_like_tables_are_compared_along_a_band(monkeypatch):
    """q26: of two tables that differ in a letter at either end, only the nodes near the diagonal are compared, not all pairs; the distance is that of all pairs."""
    table = lambda *last: "<table>" + "".join(f"<tr><td>{1000 + r}</td><td>A{r}</td><td>{x}</td></tr>" for r, x in enumerate(last)) + "</table>"
    a, b = table("ab", *"cdefg", "hi"), table("aX", *"cdefg", "hX")
    calls, distance = [], trees.Pattern.distance
    monkeypatch.setattr(trees.Pattern, "distance", lambda self, items: calls.append(items) or distance(self, items))
    size = 7 + 21
    assert M.similarities(a, b) == (1.0, 1.0 - 1.0 / size, None) and len(calls) <= 8 * size
    # a row in place of another, one more at the end, cells dropped: with all pairs in arrays
    for x, y in ((a, table("ab", *"cdef", "hi", "z")), (table(*"abc"), table(*"xyzuvw")), (a.replace("<td>d</td>", ""), b), (table(*"ab"), a.replace("</tr><tr>", "", 3))):
        some = M.similarities(x, y)
        monkeypatch.setattr(M, "SMALL", 0)
        assert M.similarities(x, y)[:2] == pytest.approx(some[:2])
        monkeypatch.setattr(M, "SMALL", 1 << 40)
