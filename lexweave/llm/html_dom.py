"""A small tolerant HTML parser: block elements as a flat tree in page order, with the text of each."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^<>]*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])(id|class|role|hidden|style|itemprop|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
#: Inline elements that never hold an article's text.
SILENT = frozenset("button svg canvas audio video object".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select legend".split()
)
#: A start tag ends these, if they are open with none of the scopes between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_P_ENDERS = BLOCK - {"html", "head", "body", "option", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SCOPES = frozenset("table td th button object caption html".split())
#: A table's own end tags reach over open cells.
_OF_TABLES, _TABLE_SCOPES = frozenset("table tbody thead tfoot tr td th caption".split()), frozenset({"table", "html"})


@dataclass
class Tree:
    """Nodes in page order, the root first. ``end``: the number after a node's last descendant. ``texts``: (place on the page, text) of
    a node's own, one for each stretch between child blocks."""

    tags: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    kids: list[list[int]] = field(default_factory=list)
    texts: list[list[tuple[int, str]]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.tags)

    def add(self, tag: str, mark: str, parent: int, texts: list[tuple[int, str]]) -> int:
        n = len(self.tags)
        for column, value in ((self.tags, tag), (self.marks, mark), (self.parent, parent), (self.kids, []), (self.texts, texts)):
            column.append(value)
        if parent >= 0:
            self.kids[parent].append(n)
        return n

    def close(self) -> Tree:
        """Set ``end`` once all nodes are there."""
        self.end = list(range(1, len(self) + 1))
        for n in range(len(self) - 1, 0, -1):
            p = self.parent[n]
            self.end[p] = max(self.end[p], self.end[n])
        return self


def mark_of(attributes: str) -> str:
    """What tells an element's part on the page: role, class words and id without their digits, and whether it is hidden."""
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(next((v for v in values if v), "")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            found.append("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            found += re.sub(r"\d+", "", value).split()
    return " ".join(sorted(set(found)))


def parse(page: str, is_aside=lambda tag, mark: False) -> Tree:
    """The tree of block elements, of any depth. Inline elements leave no node; unknown ones count as inline. ``br`` is white space.

    Start tags end open paragraphs, items and cells as browsers do; an end tag without its element only ends the block's text; what is open
    at the end is closed there. Comments, scripts, styles and other raw content give no text, nor do inline elements that
    ``is_aside(tag, mark)`` or SILENT names, up to their own end tag or the end of the block around them.
    """
    tree = Tree()
    stack, order, text = [tree.add("#root", "", -1, [])], 0, []
    opened: Counter[str] = Counter()
    silent, silent_depth, silent_blocks = "", 0, []
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal order
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                tree.texts[stack[-1]].append((order, joined))
                order += 1

    def close(depth: int) -> None:
        flush()
        opened.subtract(tree.tags[n] for n in stack[depth:])
        del stack[depth:]

    def last(names, scopes) -> int:
        """Depth of the innermost open element of ``names``, 0 if there is none or a scope stands before it."""
        if not any(opened[t] > 0 for t in names):
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            tag = tree.tags[stack[depth]]
            if tag in names:
                return depth
            if tag in scopes:
                return 0
        return 0

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            if not silent:
                text.append(page[at:])
            break
        if m.start() > at and not silent:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if silent:
            if m[1] and tag == silent:
                silent_depth -= 1
                silent = silent if silent_depth else ""
                continue
            if m[1] and tag in BLOCK and tag in silent_blocks:
                del silent_blocks[len(silent_blocks) - 1 - silent_blocks[::-1].index(tag) :]
                continue
            ends = opened[tag] > 0 if m[1] else tag in _P_ENDERS and not silent_blocks and last({"p"}, _SCOPES)
            if not (tag in BLOCK and ends):
                silent_depth += not m[1] and tag == silent
                if not m[1] and tag in BLOCK and tag not in VOID:
                    silent_blocks.append(tag)
                if m[1] or tag not in RAW:
                    continue
            else:
                silent = ""
        if m[1]:
            if tag in BLOCK:
                flush()
                if depth := last({tag}, _TABLE_SCOPES - {tag} if tag in _OF_TABLES else _SCOPES - {tag} if tag != "html" else frozenset()):
                    close(depth)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            after = page.find(">", stop.start()) if stop else -1
            at = after + 1 if after >= 0 else end
            text.append(" ")
            continue
        if tag in ("br", "hr", "img", "wbr", "input"):
            if tag == "hr":
                flush()
            elif tag != "wbr":
                text.append(" ")
            continue
        if tag in VOID:
            continue
        if tag not in BLOCK:
            if not m[3].endswith("/") and (tag in SILENT or m[3].strip() and is_aside(tag, mark_of(m[3]))):
                silent, silent_depth, silent_blocks = tag, 1, []
                text.append(" ")
            continue
        flush()
        if tag in ("html", "body", "head") and opened[tag] > 0:
            continue
        if tag == "body" and (depth := last({"head"}, frozenset())):
            close(depth)
        if tag in _P_ENDERS and (depth := last({"p"}, _SCOPES)):
            close(depth)
        if tag in _ENDS and (depth := last(*_ENDS[tag])):
            while depth > 1 and tree.tags[stack[depth - 1]] in _ENDS[tag][0]:
                depth -= 1
            close(depth)
        stack.append(tree.add(tag, mark_of(m[3]) if m[3].strip() else "", stack[-1], []))
        opened[tag] += 1
    flush()
    return tree.close()
