"""Differences of two markups for reports, and grid lines from positions on one axis. Pure Python and numpy."""

from __future__ import annotations

import difflib
import html
import re

import numpy as np

from .markup import parse

_TOKEN = re.compile(r"<[^>]+>|[^<\s]+")


def tokens(markup: str | None) -> list[str]:
    """Tags and words, in order."""
    return _TOKEN.findall(markup or "")


def operations(a: str | None, b: str | None) -> list[tuple[str, str, str]]:
    """(kind, from, to) of the parts of two markups that differ, token by token."""
    sides = tokens(a), tokens(b)
    steps = difflib.SequenceMatcher(None, *sides, autojunk=False).get_opcodes()
    return [(kind, " ".join(sides[0][slice(*ends[:2])]), " ".join(sides[1][slice(*ends[2:])])) for kind, *ends in steps if kind != "equal"]


def tag_lines(markup: str | None) -> list[str]:
    """The markup in lines, cut between a tag's end and the next one's start."""
    return re.split(r"(?<=>)(?=<)", markup) if markup else []


def shortened(text: str, most: int, mark: str = "…") -> str:
    """The text, or its first `most` characters and the mark."""
    return text if len(text) <= most else text[:most] + mark


def changed_lines(a: str | None, b: str | None, names: tuple[str, str] = ("true", "predicted"), context: int = 3) -> list[str]:
    """All lines of a unified diff of two markups, line by tag."""
    return list(difflib.unified_diff(tag_lines(a), tag_lines(b), *names, n=context, lineterm=""))


def outer_rows(markup: str | None, k: int) -> list[str]:
    """The markup of the first and the last k / 2 rows, the larger half last, or of all rows if there are no more than k; from the parsed tree, so that rows may have attributes."""
    rows = [n.markup() for n in parse(markup).walk() if n.tag == "tr"]
    keep = set(range(k // 2)) | set(range(len(rows) - k + k // 2, len(rows)))
    return [r for at, r in enumerate(rows) if len(rows) <= k or at in keep]


def plain(markup: str | None, limit: int | None = None) -> str:
    """Without tags, entities as characters, blanks squashed."""
    words = html.unescape(" ".join(re.split(r"<[^>]+>", markup or ""))).split()
    return " ".join(words)[:limit]


def centres(positions: list[float], k: int, times: list[int] | None = None) -> list[float]:
    """Ascending means of the k groups of neighbours whose squares add up to least, positions counted `times`: an exact clustering on a line.

    The best last group's start moves on with its end, so that each layer of the recurrence over prefix sums is solved by
    halves: k * n * log n for n different positions, which stay together. Of equally good groups those that begin first are
    taken. Fewer positions than groups: the last one repeated; none, none.
    """
    x, at = np.unique(np.asarray(positions, float), return_inverse=True)
    n = len(x)
    if k <= 0 or not n:
        return []
    if n <= k:
        return x.tolist() + [float(x[-1])] * (k - n)
    weight = np.bincount(at, times)
    count, one, two = (np.concatenate(([0.0], np.cumsum(v))) for v in (weight, weight * x, weight * x * x))

    def spread(first: np.ndarray, last: int) -> np.ndarray:
        return two[last] - two[first] - (one[last] - one[first]) ** 2 / (count[last] - count[first])

    cost = np.concatenate(([0.0], np.full(n, np.inf)))
    cuts = []
    for groups in range(1, k + 1):
        nearer, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        halves = [(groups, n, groups - 1, n - 1)]  # ends, and where the last group can begin
        while halves:
            low, high, least, most = halves.pop()
            if low > high:
                continue
            middle = (low + high) // 2
            first = np.arange(least, min(middle - 1, most) + 1)
            whole = cost[first] + spread(first, middle)
            best = int(np.argmin(whole))
            nearer[middle], cut[middle] = whole[best], first[best]
            halves += [(low, middle - 1, least, cut[middle]), (middle + 1, high, cut[middle], most)]
        cost = nearer
        cuts.append(cut)
    out, last = [], n
    for cut in reversed(cuts):
        first = cut[last]
        out.append(float((one[last] - one[first]) / (count[last] - count[first])))
        last = first
    return out[::-1]


def centres_of_many(x: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """`centres` of many rows at once: a row of k for each row of x, whose positions ascend and stand `times` each. All starts of a last group are tried, so that rows should be short."""
    rows, n = x.shape
    if n <= k:
        return np.concatenate([x, np.repeat(x[:, -1:], k - n, axis=1)], axis=1)
    weight, none = times.astype(float), np.zeros((rows, 1))
    count, one, two = (np.concatenate((none, np.cumsum(v, axis=1)), axis=1) for v in (weight, weight * x, weight * x * x))
    cost = np.concatenate((none, np.full((rows, n), np.inf)), axis=1)
    cuts = []
    for groups in range(1, k + 1):
        nearer, cut = np.full((rows, n + 1), np.inf), np.zeros((rows, n + 1), np.int64)
        for last in range(groups, n + 1) if groups < k else [n]:
            first = slice(groups - 1, last if groups > 1 else 1)
            whole = cost[:, first] + (two[:, [last]] - two[:, first] - (one[:, [last]] - one[:, first]) ** 2 / (count[:, [last]] - count[:, first]))
            best = np.argmin(whole, axis=1)
            nearer[:, last], cut[:, last] = whole[np.arange(rows), best], best + groups - 1
        cost = nearer
        cuts.append(cut)
    out, at, last = np.zeros((rows, k)), np.arange(rows), np.full(rows, n)
    for group, cut in reversed(list(enumerate(cuts))):
        first = cut[at, last]
        out[:, group] = (one[at, last] - one[at, first]) / (count[at, last] - count[at, first])
        last = first
    return out


def grid_edges(ruled: list[float], positions: list[float], n: int, low: float, high: float, times: list[int] | None = None) -> tuple[list[float], str]:
    """The n + 1 edges of n tracks and what they were taken from: `line`, the first ruling lines if there are enough; `distribution`, half-way between the centres of positions; `uniform` steps without positions."""
    if n > 0 and len(ruled) > n:
        return sorted(ruled)[: n + 1], "line"
    if n > 0 and len(middle := np.asarray(centres(positions, n, times))):
        return [low, *np.rint((middle[1:] + middle[:-1]) / 2).tolist(), high], "distribution"
    return np.rint(np.linspace(low, high, max(n, 1) + 1)).tolist() if n else [low], "uniform"
