"""Sibling lists are aligned by one rule, whatever their length."""

import random

import pytest

from lexweave.llm import wrapper
from lexweave.llm.html_dom import parse

R = random.Random(4)


def plain(left, right, weight):
    """The alignment by its definition, over the whole matrix."""
    m, n = len(left), len(right)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    w = lambda i, j: weight.get((left[i - 1], right[j - 1]), 0)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w(i, j))
    pairs, i, j = [], m, n
    while i and j:
        if w(i, j) and best[i][j] == best[i - 1][j - 1] + w(i, j):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n], pairs[::-1]


@pytest.mark.parametrize("most", [0, wrapper.LISTS_MOST])
def test_alignments_by_the_whole_matrix(monkeypatch, most):
    monkeypatch.setattr(wrapper, "LISTS_MOST", most)
    for _ in range(150):
        kinds = R.randint(1, 6)
        left, right = ([R.randrange(kinds) for _ in range(R.randint(1, 40))] for _ in range(2))
        weight = {(x, y): R.randint(1, 5) for x in range(kinds) for y in range(kinds) if x == y or R.random() < 0.4}
        assert wrapper.heaviest(left, right, weight) == plain(left, right, weight)


def test_long_lists_prefer_the_heavier_match():
    """A light stretch of equal tags is longer than any stretch of the heavy ones, which the matching of stretches took first."""
    heavy, light = "<div class=a><p>x</p><ul><li>x</li></ul><h2>x</h2></div>", "<h4>x</h4><h5>x</h5><blockquote>x</blockquote>"
    parts = {"h": heavy + "<h3>x</h3>", "l": light}
    for times in (3, 1200):
        one, other = ("<section>" + "".join(parts[k] * times for k in order) + "<h6>x</h6></section>" for order in ("hl", "lh"))
        a, b = (wrapper.skeleton(parse(f"<body><p>x</p>{t}</body>", wrapper.named_aside)) for t in (one, other))
        found = wrapper.tree_match(a, b)[1]
        assert sum(a.tags[x] == "div" for x, _ in found) == times and not any(a.tags[x] == "h4" for x, _ in found)
