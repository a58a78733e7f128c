"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise
from .html_dom import Tree, parse

#: Wrappers of more bytes together are joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 16 << 20
#: Sums of so many nodes are held in a task before they are passed on. Sibling lists of more cells than this are aligned by rows of
#: arrays instead of lists: the same alignment, faster, and without the whole matrix in memory.
HELD_MOST, LISTS_MOST = 50_000, 1 << 12

# Fixed lists: elements and class words that never are an article's text.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog select option legend fieldset head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations trending comment comments commentlist respond reply replies disqus discussion pagination pager search searchform hidden complementary contentinfo toolbar widget".split()
)
#: Words that say nothing of their own beside an aside's word: "comment-list" is an aside, "related-work" is none.
PLAIN_WORDS = frozenset(
    "site page main top bottom left right global primary secondary box bar block container wrapper wrap inner outer section area list links link posts post articles article stories story items item content buttons button icons icon panel slot unit zone module row col column text title heading body us up news user users reader readers blog wp js id the".split()
)
MAIN_TAGS = ("article", "main")
#: Of these, such ones aren't the page's article after all.
NOT_MAIN_WORDS = frozenset("comment comments reply replies hidden related recommended ad ads advert promo teaser sponsored".split())
MAIN_WORDS = frozenset("article articlebody content main post story entry body text".split())
HEADER_WORDS = frozenset({"header", "masthead", "topbar"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z]+")


@lru_cache(maxsize=1 << 16)
def says(mark: str, words: frozenset[str]) -> bool:
    """Whether one of the mark's classes consists of ``words``, plain words beside them or not."""
    for token in mark.split():
        parts = [p for p in _SPLIT.split(token) if p]
        if any(p in words for p in parts) and all(p in words or p in PLAIN_WORDS for p in parts):
            return True
    return False


def _words(mark: str) -> frozenset[str]:
    return frozenset(_SPLIT.split(mark)) if mark else frozenset()


def named_aside(tag: str, mark: str) -> bool:
    """Whether an element's name or class says that it isn't the article, wherever it stands."""
    return tag in ASIDE_TAGS or bool(mark) and says(mark, ASIDE_WORDS)


def asides(tree: Tree) -> list[bool]:
    """For each node whether it or an element around it is an aside.

    A page's header is one, an article's isn't: it may hold the title. What holds an article or main element isn't one for its class,
    and a form isn't one if it holds such an element or a title, as some pages are one form.
    """
    n = len(tree)
    holds, titled = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        p, mine = tree.parent[i], tree.tags[i] in MAIN_TAGS and not says(tree.marks[i], NOT_MAIN_WORDS)
        holds[p] = holds[p] or holds[i] or mine
        titled[p] = titled[p] or titled[i] or tree.tags[i] == "h1"
    out, inside = [False] * n, [False] * n
    for i in range(1, n):
        p, tag, mark = tree.parent[i], tree.tags[i], tree.marks[i]
        inside[i] = inside[p] or tag in MAIN_TAGS
        if tag in MAIN_TAGS:
            mine = says(mark, NOT_MAIN_WORDS)
        elif tag in ("html", "body"):
            mine = False
        elif tag == "form":
            mine = not (holds[i] or titled[i])
        elif tag in ASIDE_TAGS:
            mine = True
        else:
            mine = not holds[i] and (bool(mark) and says(mark, ASIDE_WORDS) or not inside[p] and (tag == "header" or bool(mark) and says(mark, HEADER_WORDS)))
        out[i] = out[p] or mine
    return out


@dataclass
class Skeleton(Tree):
    """A page's tree with neighbouring children of one structure laid together; ``shapes`` are equal for equal subtrees."""

    shapes: list[int] = field(default_factory=list)

    def own_text(self, n: int) -> list[str]:
        return [t for _, t in self.texts[n]]


def _shapes(tree: Tree) -> list[int]:
    """A hash of each node's structure, in which runs of equal children count once."""
    out = [0] * len(tree)
    for n in range(len(tree) - 1, -1, -1):
        inner: list[int] = []
        for k in tree.kids[n]:
            if not inner or inner[-1] != out[k]:
                inner.append(out[k])
        out[n] = xxhash.xxh3_64_intdigest(f"{tree.tags[n]}.{tree.marks[n]}({','.join(map(str, inner))})")
    return out


def skeleton(tree: Tree) -> Skeleton:
    shapes = _shapes(tree)
    out = Skeleton()
    waiting = [([0], -1)]
    while waiting:
        group, parent = waiting.pop()
        node = out.add(tree.tags[group[0]], tree.marks[group[0]], parent, [t for n in group for t in tree.texts[n]])
        out.shapes.append(shapes[group[0]])
        runs: list[list[int]] = []
        for n in group:
            # all of a group have the same runs of children
            r, before = -1, None
            for k in tree.kids[n]:
                if shapes[k] != before:
                    r, before = r + 1, shapes[k]
                    if r == len(runs):
                        runs.append([])
                runs[r].append(k)
        waiting += [(run, node) for run in reversed(runs)]
    return out.close()


def to_text(s: Skeleton) -> str:
    """A skeleton with the hashes of its texts, in page order; a node's parent by its number."""
    return json.dumps([[p, t, m, [zlib.crc32(x.encode("utf-8", "replace")) for x in s.own_text(n)]] for n, (p, t, m) in enumerate(zip(s.parent, s.tags, s.marks, strict=True))])


def from_text(text: str) -> Skeleton:
    """The skeleton again; its texts are hashes."""
    out = Skeleton()
    for parent, tag, mark, hashes in json.loads(text):
        out.add(tag, mark, parent, hashes)
    out.shapes = _shapes(out)
    return out.close()


Pairs = list[tuple[int, int]]


def heaviest(left: list[int], right: list[int], weight: dict[tuple[int, int], int]) -> tuple[int, Pairs]:
    """The heaviest alignment of two lists in order: its weight and places, by the weights of pairs of values. From the end, a pair is
    taken if it can stand there, else the left list's last is left out if it can be, else the right one's; so for lists of any length.

    Of long lists every so many rows of the matrix are kept, the root of their number; those between are worked out again on the way back.
    """
    m, n = len(left), len(right)
    if m * n <= LISTS_MOST:
        every = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(1, m + 1):
            above, line, x = every[i - 1], every[i], left[i - 1]
            for j in range(1, n + 1):
                here = above[j] if above[j] >= line[j - 1] else line[j - 1]
                w = weight.get((x, right[j - 1]), 0)
                line[j] = above[j - 1] + w if w and above[j - 1] + w > here else here
        step, total, block = m, every[m][n], lambda low: every
    else:
        places: dict[int, list[int]] = {}
        for j, y in enumerate(right):
            places.setdefault(y, []).append(j)
        columns = {y: np.array(at, np.int64) for y, at in places.items()}
        weights: dict[int, list[tuple[np.ndarray, int]]] = {}
        for (x, y), w in weight.items():
            if y in columns:
                weights.setdefault(x, []).append((columns[y], w))

        def after(above: np.ndarray, x: int) -> np.ndarray:
            line = above.copy()
            for at, w in weights.get(x, ()):
                line[at + 1] = np.maximum(line[at + 1], above[at] + w)
            return np.maximum.accumulate(line, out=line)

        step, kept, line = isqrt(m - 1) + 1, [], np.zeros(n + 1, np.int32)
        for i, x in enumerate(left):
            if i % step == 0:
                kept.append(line)
            line = after(line, x)
        total = int(line[n])

        def block(low: int) -> list:
            lines = [kept[low // step]]
            for x in left[low : low + step]:
                lines.append(after(lines[-1], x))
            return lines

    pairs: Pairs = []
    i, j = m, n
    while i and j:
        low = (i - 1) // step * step
        best = block(low)
        while i > low and j:
            w = weight.get((left[i - 1], right[j - 1]), 0)
            here, above = best[i - low], best[i - low - 1]
            if w and here[j] == above[j - 1] + w:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
    return total, pairs[::-1]


def tree_match(a: Skeleton, b: Skeleton) -> tuple[int, Pairs]:
    """Simple tree matching: the size of the largest match that keeps order and depth, and its pairs of nodes.

    Subtrees of one shape are matched whole, also at both ends of sibling lists, where that never loses a match. Pairs of shapes are
    matched once. Without recursion, so of any depth.
    """
    known: dict[tuple[int, int], tuple[int, Pairs]] = {}

    def label(s: Skeleton, n: int) -> tuple[str, str]:
        return s.tags[n], s.marks[n]

    def ends(left: list[int], right: list[int]) -> tuple[int, int]:
        """How many children at the beginning and at the end have equal shapes."""
        most = min(len(left), len(right))
        head = 0
        while head < most and a.shapes[left[head]] == b.shapes[right[head]]:
            head += 1
        tail = 0
        while tail < most - head and a.shapes[left[-1 - tail]] == b.shapes[right[-1 - tail]]:
            tail += 1
        return head, tail

    waiting = [(0, 0)]
    while waiting:
        x, y = waiting[-1]
        key = a.shapes[x], b.shapes[y]
        if key in known or key[0] == key[1] or label(a, x) != label(b, y):
            waiting.pop()
            continue
        left, right = a.kids[x], b.kids[y]
        head, tail = ends(left, right)
        inner_left, inner_right = left[head : len(left) - tail], right[head : len(right) - tail]
        # one node of each shape stands for all; they are matched if their labels are equal
        shapes_left, by_label = {a.shapes[p]: p for p in inner_left}, {}
        for shape, q in {b.shapes[q]: q for q in inner_right}.items():
            by_label.setdefault(label(b, q), []).append((shape, q))
        alike = [(u, v, p, q) for u, p in shapes_left.items() for v, q in by_label.get(label(a, p), ())]
        missing = [(p, q) for u, v, p, q in alike if u != v and (u, v) not in known]
        if missing:
            waiting += missing
            continue
        waiting.pop()
        weight = {(u, v): a.end[p] - p if u == v else known[u, v][0] for u, v, p, q in alike}
        score, pairs = heaviest([a.shapes[p] for p in inner_left], [b.shapes[q] for q in inner_right], weight) if weight else (0, [])
        score += 1 + sum(a.end[k] - k for k in left[:head]) + sum(a.end[k] - k for k in left[len(left) - tail :])
        known[key] = score, [(head + i, head + j) for i, j in pairs]
    if label(a, 0) != label(b, 0):
        return 0, []
    if a.shapes[0] == b.shapes[0]:
        total = len(a)
    else:
        total = known[a.shapes[0], b.shapes[0]][0]
    found: Pairs = []
    walk = [(0, 0)]
    while walk:
        x, y = walk.pop()
        if a.shapes[x] == b.shapes[y]:
            # one shape: the same nodes in the same order
            found += zip(range(x, a.end[x]), range(y, b.end[y]), strict=True)
            continue
        found.append((x, y))
        left, right = a.kids[x], b.kids[y]
        head, tail = ends(left, right)
        walk += zip(left[:head], right[:head], strict=True)
        walk += zip(left[len(left) - tail :], right[len(right) - tail :], strict=True)
        walk += [(left[i], right[j]) for i, j in known[a.shapes[x], b.shapes[y]][1]]
    return total, found


def aligned(pivot: Skeleton, page: Skeleton) -> dict[int, int]:
    """For each matched node of the page the node of the pivot."""
    return {y: x for x, y in tree_match(pivot, page)[1]}


def content_node(tree: Skeleton, mass: list[int]) -> tuple[int, bool]:
    """The node that holds the article, and whether an element or class names it: an article or main element with most of what varies,
    else the innermost one marked as content with most of it, else the deepest node with all that varies outside of asides.
    ``mass``: characters that vary, by node."""
    out = asides(tree)
    total = [0 if out[n] else mass[n] for n in range(len(tree))]
    for n in range(len(tree) - 1, 0, -1):
        total[tree.parent[n]] += total[n]
    whole = total[0]
    for tag in MAIN_TAGS:
        found = [n for n in range(len(tree)) if tree.tags[n] == tag and not out[n] and total[n] > 0]
        if found:
            return max(found, key=lambda n: (total[n], -n)), True
    marked = [n for n in range(len(tree)) if not out[n] and total[n] * 2 > whole and tree.tags[n] not in ("html", "body") and _words(tree.marks[n]) & MAIN_WORDS]
    if marked:
        return marked[-1], True
    best = 0
    for n in range(len(tree)):
        if whole and not out[n] and total[n] == whole and tree.tags[n] not in ("p", "li", "td", *HEADINGS):
            best = n
    return best, False


def article_text(tree: Skeleton, content: int, constant=None) -> str:
    """Blocks of the content in page order, less asides. With ``constant`` (of a node, whether each of its texts is the same on all
    pages): constant blocks before the first and after the last that varies are template too, but for headings."""
    out, blocks, n = asides(tree), [], content
    while n < tree.end[content]:
        if out[n] and n != content:
            n = tree.end[n]
            continue
        same = constant(n) if constant else ()
        blocks += [(at, t, bool(constant) and same[k] and tree.tags[n] not in HEADINGS) for k, (at, t) in enumerate(tree.texts[n])]
        n += 1
    blocks.sort()
    vary = [k for k, b in enumerate(blocks) if not b[2]]
    if vary:
        blocks = blocks[vary[0] : vary[-1] + 1]
    return "\n".join(t for _, t, _ in blocks)


@dataclass
class Wrapper:
    pivot: Skeleton
    content: int
    named: bool
    #: of each node: whether its own text is template, and how many texts at its beginning and end are
    template: dict[int, tuple[bool, int, int]]


@lru_cache(maxsize=4096)
def _pivot(text: str) -> Skeleton:
    return from_text(text)


@lru_cache(maxsize=4096)
def induce(pivot_text: str, stats_text: str | None) -> Wrapper:
    """Own texts that are the same on all pages that have the node, two different pages at least, become template; the node that holds
    what varies becomes content."""
    pivot = _pivot(pivot_text)
    stats = json.loads(stats_text or "[]")
    mass = [0] * len(pivot)
    for r in stats:
        mass[r["node"]] = r["extra"] + (0 if r["same"] else r["chars"])
    template = {r["node"]: (r["same"], r["head"], r["tail"]) for r in stats if r["several"]}
    if not any(mass):
        # all pages are alike: nothing tells template from content but the elements themselves
        template = {}
        for r in stats:
            mass[r["node"]] = r["chars"]
    return Wrapper(pivot, *content_node(pivot, mass), template)


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """A page's main text by its host's wrapper; where the content isn't found, by a wrapper of the page alone."""
    tree = skeleton(parse(page or "", named_aside))
    if wrapper is not None:
        at = aligned(wrapper.pivot, tree)
        content = next((y for y, x in at.items() if x == wrapper.content), None)
        if content is not None:

            def constant(n: int) -> list[bool]:
                same, head, tail = wrapper.template.get(at.get(n, -1), (False, 0, 0))
                m = len(tree.texts[n])
                return [same or k < head or k >= m - tail for k in range(m)]

            text = article_text(tree, content, None if wrapper.named else constant)
            if text:
                return text
    return article_text(tree, content_node(tree, [sum(map(len, tree.own_text(n))) for n in range(len(tree))])[0])


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _extra_keys(tree: Skeleton, at: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(node, pivot node, key) of each node: 0 for one that the pivot has, else the nearest pivot node above and a hash of the path from it."""
    keys: dict[int, tuple[int, int]] = {}
    seen: dict[int, int] = {}
    for n in range(len(tree)):
        if n in at:
            keys[n] = at[n], 0
        else:
            above = keys.get(tree.parent[n], (0, 0))
            path = xxhash.xxh3_64_intdigest(f"{above} {tree.tags[n]}.{tree.marks[n]}") >> 1
            seen[path] = seen.get(path, 0) + 1
            keys[n] = above[0], (path ^ (seen[path] << 40)) % (1 << 63) or 1
        yield n, *keys[n]


#: What is summed for each node: pages, least and greatest hash of its text and of the pages, equal texts at both ends, characters.
_SUMS = ("low", "high", "page_low", "page_high", "head", "tail", "chars")
_STATS = "host string, node int, extra long, " + ", ".join(f"{c} long" for c in _SUMS)


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) << 20 | len(text) & 0xFFFFF


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, host, text) of every page.

    1. Each host's pivot is the skeleton of its page with the least id. Tasks reduce their pages first.
    2. Every page is aligned with its host's pivot by simple tree matching, one alignment a page whatever the host's size. For each
       node of the pivot, and for each place that only other pages have, tasks and then Spark reduce the least and greatest hash of its
       own text, and how many of its texts at both ends are the pivot's.
    3. A node's own text that is the same on all its pages, of two different ones at least, is template; its subtree isn't. The content
       node holds what varies. Every page is aligned again and read by the wrapper: all of the content but asides by element or class;
       where no element or class names the content, also without constant blocks before the first and after the last that varies,
       headings apart. Constant text between what varies, or in a named article, stays.

    Pivots and wrappers are small; they are broadcast if their bytes, counted first, are at most BROADCAST_BYTES, else joined by host,
    where adaptive execution can split a hot host. Null html counts as empty and gives an empty text; a null url belongs to the host
    of no name; null ids and repeated rows are kept; whole pages of any length and depth are read. An empty table gives no row.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, tuple] = {}
        for batch in batches:
            for key, host, page in zip(*(batch.column(c).to_pylist() for c in ("id", "host", "html")), strict=True):
                rank = (not page, key is None, key)
                if host not in least or rank < least[host][0]:
                    least[host] = rank, page
        hosts = sorted(least)
        ids = [least[h][0][2] for h in hosts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array([least[h][0][0] for h in hosts], pa.bool_()), pa.array(ids, pa.int64()), pa.array([to_text(skeleton(parse(least[h][1], named_aside))) for h in hosts], pa.string())],
            names=["host", "blank", "id", "pivot"],
        )

    first = rows.withColumn("id", F.col("id").cast("long")).mapInArrow(pick, "host string, blank boolean, id long, pivot string")
    pivots = materialise(first.groupBy("host").agg(F.min(F.struct("blank", F.col("id").isNull().alias("none"), "id", "pivot")).alias("p")).select("host", "p.pivot"), "pivots")

    def with_host(known: DataFrame, size) -> DataFrame:
        total = known.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        return rows.join(F.broadcast(known) if total <= BROADCAST_BYTES else known, "host", "left")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], list[int]] = {}

        def put() -> pa.RecordBatch:
            found = list(sums.items())
            sums.clear()
            keys = [pa.array([k[i] for k, _ in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*keys, *(pa.array([r[i] for _, r in found], pa.int64()) for i in range(len(_SUMS)))], names=["host", "node", "extra", *_SUMS])

        for batch in batches:
            for host, page, pivot_text in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "pivot")), strict=True):
                if not page:
                    continue
                pivot, tree, whole = _pivot(pivot_text), skeleton(parse(page, named_aside)), _crc(page)
                for n, node, extra in _extra_keys(tree, aligned(pivot, tree)):
                    texts = tree.own_text(n)
                    digest, head, tail = _crc("\n".join(texts)), 0, 0
                    if not extra and texts:
                        mine, there = [zlib.crc32(t.encode("utf-8", "replace")) for t in texts], pivot.texts[node]
                        most = min(len(mine), len(there))
                        while head < most and mine[head] == there[head]:
                            head += 1
                        while tail < most and mine[-1 - tail] == there[-1 - tail]:
                            tail += 1
                    key, new = (host, node, extra), (digest, digest, whole, whole, head, tail, sum(map(len, texts)))
                    r = sums.get(key)
                    sums[key] = list(new) if r is None else [min(r[0], digest), max(r[1], digest), min(r[2], whole), max(r[3], whole), min(r[4], head), min(r[5], tail), r[6] + new[6]]
            if len(sums) > HELD_MOST:
                yield put()
        yield put()

    measured = with_host(pivots, F.octet_length("pivot")).select("host", "html", "pivot").mapInArrow(measure, _STATS)
    low, high = (lambda c: F.min(c).alias(c)), (lambda c: F.max(c).alias(c))
    stats = measured.groupBy("host", "node", "extra").agg(low("low"), high("high"), low("page_low"), high("page_high"), low("head"), low("tail"), F.sum("chars").alias("chars"))
    own, several = F.col("extra") == 0, F.col("page_low") < F.col("page_high")
    same = several & (F.col("low") == F.col("high"))
    of = lambda c: F.max(F.when(own, c))
    # a row for each node of the pivot, which bounds a host's list
    stats = stats.groupBy("host", "node").agg(
        F.coalesce(of(same), F.lit(True)).alias("same"), F.coalesce(of(several), F.lit(False)).alias("several"), F.coalesce(of(F.col("head")), F.lit(0)).alias("head"), F.coalesce(of(F.col("tail")), F.lit(0)).alias("tail"),
        F.coalesce(of(F.col("chars")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(~own & ~same, F.col("chars"))), F.lit(0)).alias("extra"),
    )
    stats = stats.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("node", "same", "several", "head", "tail", "chars", "extra")))).alias("stats"))
    wrappers = materialise(pivots.join(stats, "host", "left"), "wrappers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                extract(page, induce(pivot, stats) if pivot is not None else None)
                for page, pivot, stats in zip(*(batch.column(c).to_pylist() for c in ("html", "pivot", "stats")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.string())], names=["id", "url", "host", "text"])

    joined = with_host(wrappers, F.octet_length("pivot") + F.coalesce(F.octet_length("stats"), F.lit(0)))
    read_rows = joined.select("id", "url", "host", "html", "pivot", "stats").mapInArrow(read, f"id {id_type}, url string, host string, text string")
    return read_rows.withColumnsRenamed({"id": id_col, "url": url_col})


def op2_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    got = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
