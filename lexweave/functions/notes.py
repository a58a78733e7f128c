"""Notes and their evidence: anchors, quantities, checks, schemas, rendering."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from difflib import SequenceMatcher

from .tokens import TENS, UNIT_OF, WORD_VALUE

#: A fuzzy anchor's least ratio, a stub's most words, and what tells an advertisement.
FUZZY, STUB, DROPPED_MOST = 0.85, 5, 0.2
AD = re.compile(r"\b(?:discount code|promo code|coupon code|use (?:the )?code|sponsored by|our sponsor|today'?s sponsor|brought to you by|affiliate link|patreon)\b", re.IGNORECASE)


def plain_with_index(raw: str) -> tuple[str, list[int]]:
    """ASCII letters and digits in lower case, all else one space; and where each of them stood in the NFKC text."""
    text = unicodedata.normalize("NFKC", raw)
    out, index = [], []
    for m in re.finditer(r"[A-Za-z0-9]+|[^A-Za-z0-9]+", text):
        if m[0][0].isascii() and m[0][0].isalnum():
            out.append(m[0].lower())
            index += range(m.start(), m.end())
        elif out and m.end() < len(text):
            out.append(" ")
            index.append(m.start())
    return "".join(out), index


def locate(transcript: str, anchor: str) -> tuple[int | None, bool]:
    """Where an anchor stands in the plain transcript, and whether only nearly: four words or more, one of its first three in front."""
    text, needle = plain_with_index(transcript)[0], plain_with_index(anchor)[0]
    if not needle:
        return None, False
    at = text.find(needle)
    if at >= 0:
        return at, False
    want, have = needle.split(), text.split()
    if len(want) < 4:
        return None, False
    best, place = 0.0, None
    for i in (i for i, w in enumerate(have[: max(1, len(have) - len(want) + 1)]) if w in want[:3]):
        r = SequenceMatcher(None, want, have[i : i + len(want)]).ratio()
        if r > best:
            best, place = r, i
    return (len(" ".join(have[:place])) + (place > 0), True) if best >= FUZZY else (None, False)


def is_stub(text: str) -> bool:
    return len(text.split()) <= STUB and not re.search(r"\d|\{\{", text)


def check_units(units: list[tuple[str, str]], transcript: str) -> tuple[list[tuple[str, str]], list[str], bool]:
    """Units (text, anchor) that stay, why the others go, and whether the note is rejected: nothing left, or too much dropped."""
    kept, reasons, anchored, dropped = [], [], 0, 0
    for text, anchor in units:
        if is_stub(text):
            reasons.append("label_only")
            continue
        anchored += 1
        reason = "ad_or_sponsor" if AD.search(text) else "anchor_not_in_transcript" if locate(transcript, anchor)[0] is None else None
        if reason:
            dropped += 1
            reasons.append(reason)
        else:
            kept.append((text, anchor))
    return kept, reasons, not kept or dropped > DROPPED_MOST * anchored


def quantity_mentions(text: str) -> list[tuple[int, Decimal, str]]:
    """(place, value, unit) of numbers with a unit in the two words after them, and of years."""
    out = []
    tokens = [(m.start(), m[0].lower()) for m in re.finditer(r"\d+(?:[.,]\d+)*|[A-Za-z]+|%", text)]
    for i, (at, t) in enumerate(tokens):
        if t[0].isdigit():
            value = Decimal(re.sub(r",(?=\d{3}(?!\d))", "", t).replace(",", "."))if t.count(".") + t.count(",") <= 1 else None
        elif t in WORD_VALUE:
            nxt = tokens[i + 1][1] if i + 1 < len(tokens) else ""
            value = Decimal(WORD_VALUE[t] + (WORD_VALUE[nxt] if t in TENS and 0 < WORD_VALUE.get(nxt, 0) < 10 else 0))
        else:
            continue
        unit = next((UNIT_OF[w] for _, w in tokens[i + 1 : i + 3] if w in UNIT_OF), None)
        if value is not None and (unit or t[0].isdigit() and 1900 <= value <= 2100):
            out.append((at, value, unit or "year"))
    return out


def parse_range(text: str) -> tuple[Decimal, Decimal] | None:
    """'8', '8-12' and '8 to 12' as low and high."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(?:(?:-|–|to)\s*(\d+(?:\.\d+)?))?\s*", text)
    if not m:
        return None
    low, high = Decimal(m[1]), Decimal(m[2] or m[1])
    return (low, high) if low <= high else None


def uncovered(spots: list[tuple[int, str]], placed: list[tuple[int, str]], reach: int = 400) -> list[tuple[int, str]]:
    """Spots without a placed unit that names their term within ``reach`` characters."""
    return [(at, term) for at, term in spots if not any(abs(p - at) <= reach and term in text for p, text in placed)]


def schema_errors(value: object, schema: dict, path: str = "$") -> list[str]:
    """Paths at which a value isn't what the schema asks for: types, required and unknown fields, most items, allowed values."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "boolean": bool}
    kind = kinds[schema["type"]]
    if not isinstance(value, kind) or schema["type"] == "number" and isinstance(value, bool):
        return [f"{path}: not a {schema['type']}"]
    if "enum" in schema and value not in schema["enum"]:
        return [f"{path}: not allowed"]
    out = []
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        out += [f"{path}.{k}: unknown" for k in value if k not in fields]
        for k, sub in fields.items():
            if k in value:
                out += schema_errors(value[k], sub, f"{path}.{k}")
    if isinstance(value, list):
        if len(value) > schema.get("maxItems", len(value)):
            out.append(f"{path}: too many")
        for i, v in enumerate(value):
            out += schema_errors(v, schema["items"], f"{path}[{i}]")
    return out


def apply_fill(units: list[str], decisions: list[tuple[int, str, int | None, str]]) -> tuple[list[str], list[str]]:
    """Units after decisions (candidate, action, unit, text), and what became of each: of one candidate the first counts."""
    out, told, seen = list(units), [], set()
    for candidate, action, target, text in decisions:
        if candidate in seen:
            told.append("repeated")
            continue
        seen.add(candidate)
        if action == "skip":
            told.append("skipped")
        elif is_stub(text) or AD.search(text):
            told.append("rejected")
        elif action == "add":
            out.append(text)
            told.append("added")
        elif action == "extend" and target is not None and 0 <= target < len(units):
            out[target] += " " + text
            told.append("extended")
        else:
            told.append("rejected")
    return out, told


def front_matter(markdown: str) -> dict[str, str]:
    """Keys and plain values of a leading block between two lines of three dashes; nothing without one."""
    m = re.match(r"---\n(.*?)\n---(?:\n|\Z)", markdown, re.DOTALL)
    pairs = (line.partition(":") for line in (m[1].splitlines() if m else ()))
    return {k.strip(): v.strip().strip("\"'") for k, sep, v in pairs if sep and k.strip() and not k.startswith((" ", "-", "#"))}


def render(title: str, sections: list[tuple[str, list[str]]]) -> str:
    lines = ["---", f'title: "{title}"', "---", "", f"# {title}"]
    for name, bullets in sections:
        lines += ["", f"## {name}", "", *(f"- {b}" for b in bullets)]
    return "\n".join(lines) + "\n"
