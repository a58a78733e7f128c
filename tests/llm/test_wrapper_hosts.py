"""Main text of made-up hosts, of which the articles are known."""

import random

import pytest

from lexweave.llm import html_dom, wrapper

R = random.Random(21)
WORDS = "lift rest sleep squat press carry walk eat drink train plan note test".split()


def line(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def blocks(i):
    """A page's article: (html, text) of each block; the second heading and the last line are the same on all pages."""
    out = [(f"<h1>Title {i} {(t := line(3))}</h1>", f"Title {i} {t}"), ("<h2>Weekly report</h2>", "Weekly report")]
    out.append((f"<p>Intro {i} {(t := line(20))}", f"Intro {i} {t}"))
    items = [line(4) for _ in range(R.randint(1, 4))]
    out.append((f"<ul>{''.join(f'<li>{x}' for x in items)}</ul>", "\n".join(items)))
    out.append((f"<blockquote><p>{(t := line(9))}</p></blockquote>", t))
    cells = [[line(2), str(R.randint(1, 99))] for _ in range(R.randint(1, 3))]
    out.append((f"<table><tr><th>What<th>How much{''.join(f'<tr><td>{a}<td>{b}' for a, b in cells)}</table>", "\n".join(["What", "How much", *(x for c in cells for x in c)])))
    out.append((f"<section><h3>{(t := line(2))}</h3><ol><li>{(u := line(3))}</ol></section>", f"{t}\n{u}"))
    out.append((f"<div class='related-work'><p>{(t := line(8))}</p></div>", t))
    out.append((f"<p>One <span class='ad'>Buy <b>now</b></span> two {(t := line(5))}<p>", f"One two {t}"))
    if i % 3 == 0:
        out.append((f"<div><p>{(t := line(12))}</p><p>{(u := line(6))}</p></div>", f"{t}\n{u}"))
    out.append((f"<p>End of it {i} {(t := line(4))}</p>", f"End of it {i} {t}"))
    return out


OPEN, CLOSE = "<html><body><div>Slogan of the house</div>", "<p>All rights</p></body></html>"
NAV = "<div>" * 300 + "<nav><ul><li>Home<li>Shop</ul></nav>" + "</div>" * 300


@pytest.mark.parametrize("pages", [1, 2, 7, 8, 100])
@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<div class='post-body'>", "</div>"), ("<div>", "</div>")])
def test_articles_stay_whole(spark, pages, around):
    table, want = [], {}
    for i in range(pages):
        parts = blocks(i)
        table.append((i, "https://h.example/x", f"{OPEN}{NAV}{around[0]}{''.join(h for h, _ in parts)}{around[1]}<div class='comment-list'><p>me too {i}</p></div><footer>c</footer>{CLOSE}"))
        want[i] = "\n".join(t for _, t in parts)
    if pages == 1 and around[0] == "<div>":
        # one page of no named content tells nothing of its frame
        want[0] = f"Slogan of the house\n{want[0]}\nAll rights"
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in wrapper.main_text(df).collect()} == want


def test_deep_navigation_is_no_article():
    for depth in (1, 20, 260, 5000):
        assert wrapper.extract("<div>" * depth + "<nav><p>menu</nav>" + "</div>" * depth + "<article><p>text</article>", None) == "text"


def test_pieces_that_the_pivot_lacks(spark):
    """The page with the least id has one section, the others have more, of which one is the same on all of them."""
    def page(i, more):
        return f"<body><header>Site</header><div><section>start {i} {line(6)}</section>{more}</div><div>Imprint of the site</div></body>"

    extra = {i: f"more {i} {line(5)}" for i in range(1, 9)}
    table = [(i, "http://a.example/", page(i, f"<dl><dt>{extra[i]}</dl>" if i else "")) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    for i in range(9):
        lines = got[i].split("\n")
        assert lines[0].startswith(f"start {i} ") and lines[1:] == ([extra[i]] if i else [])


def test_constant_paragraphs_in_a_run(spark):
    """A slogan and a last line in the same run of paragraphs as the article."""
    table = [(i, "http://a.example/", f"<body><p>Same slogan</p><p>one {i}</p><p>Same in between</p><p>two {i} {line(i)}</p><p>Same end</p></body>") for i in range(3)]
    for r in wrapper.main_text(spark.createDataFrame(table, "page_id long, url string, html string")).collect():
        lines = r["text"].split("\n")
        assert lines[0] == f"one {r['page_id']}" and lines[1] == "Same in between" and lines[2].startswith(f"two {r['page_id']}") and len(lines) == 3


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<form id='aspnet'><h1>T</h1><p>text</p><form><input></form></form>", "T\ntext"),
        ("<div class='content-sidebar-wrap'><article><p>text</article><div class='sidebar'>s</div></div>", "text"),
        ("<article><p>a <span class='ad'>x<p>b</article>", "a\nb"),
        ("<article><p>a <span hidden>x <span>y</span> z</span> b <button>Go</button></article>", "a b"),
        ("<article><div class='ad-hoc'>kept</div><div class='ad-slot'>gone</div><div class='site-share-buttons'>gone</div></article>", "kept"),
    ],
)
def test_asides_by_class(html, want):
    assert wrapper.extract(html, None) == want


def brute(a, b):
    """Simple tree matching by its definition."""
    if (a[0], a[1]) != (b[0], b[1]):
        return 0
    m, n = len(a[2]), len(b[2])
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(a[2][i], b[2][j]))
    return 1 + best[m][n]


def test_tree_matching_by_brute_force():
    def made(depth):
        return "".join(f"<{t}>{made(depth - 1)}</{t}>" for t in R.choices(["div", "ul", "section"], k=R.randint(0, 4))) if depth else ""

    def nested(s, n=0):
        return s.tags[n], s.marks[n], [nested(s, k) for k in s.kids[n]]

    for _ in range(60):
        a, b = (wrapper.skeleton(html_dom.parse(made(4))) for _ in range(2))
        score, pairs = wrapper.tree_match(a, b)
        assert score == len(pairs) == brute(nested(a), nested(b))
        assert all(a.tags[x] == b.tags[y] for x, y in pairs)
        assert wrapper.from_text(wrapper.to_text(a)).shapes == a.shapes
