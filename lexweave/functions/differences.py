"""Differences between two readings, with what tells how much each matters."""

from __future__ import annotations

import re
from typing import NamedTuple

from . import rules, sequences
from .numbers import measurement_units, numbers
from .terms import Terms
from .tokens import UNIT_OF, Token, adjacent_duplicate, negations, repeat_run, tokenize

# Fixed values.
CITATION_CUES = frozenset("study studies research researcher researchers paper trial trials review meta analysis authors author published journal et al".split())
HONORIFICS = frozenset("dr prof mr mrs ms".split())
GLOSSARY_CATEGORIES = ("exercise_name", "supplement", "training_term", "scientific_medical_term", "citation", "proper_name")
UNIT_REACH, TERM_REACH, CONTEXT = 5, 2, 30
_YEAR = re.compile(r"(?:19|20)\d{2}")
_TITLED = re.compile(r"[A-Z][a-z]+(?:['’][A-Z][a-z]+)?")


class Difference(NamedTuple):
    id: int
    kind: str
    severity: str
    category: str
    apple_start: int
    apple_end: int
    whisper_start: int
    whisper_end: int
    apple_text: str
    whisper_text: str
    similarity: float
    domain_terms: list[str]
    citation_signal: bool
    source_only: str | None
    risk_reasons: list[str]
    repetition: bool


def window(tokens: list[Token], start: int, end: int, reach: int) -> list[str]:
    return [t.value for t in tokens[max(0, start - reach) : end + reach]]


def cut(text: str, tokens: list[Token], start: int, end: int) -> str:
    return text[tokens[start].start : tokens[end - 1].end] if start < end else ""


def citation_change(changed: list[str], nearby: list[str]) -> bool:
    """Whether the changed words themselves cite: "et al", or a year and a cue of which one at least is changed."""
    year = lambda ws: any(map(_YEAR.fullmatch, ws))
    cue = lambda ws: not CITATION_CUES.isdisjoint(ws)
    return ("et", "al") in zip(changed, changed[1:], strict=False) or year(changed) and cue(nearby) or cue(changed) and year(nearby)


def names_someone(tokens: list[Token], text: str) -> bool:
    """Two titled words side by side outside sentence ends, one after an honorific, or a word in capitals."""
    titled = [bool(_TITLED.fullmatch(t.original)) for t in tokens]
    pairs = list(zip(tokens, titled, titled[1:], strict=False))
    return "." not in text and any(a and b for _, a, b in pairs) or any(t.value in HONORIFICS and b for t, _, b in pairs) or any(len(t.original) >= 3 and t.original.isalpha() and t.original.isupper() for t in tokens)


def glossary_category(found: list[str], category_of: dict[str, str]) -> str:
    """The first category, in the glossary's order, that one of the terms belongs to."""
    have = {category_of.get(t) for t in found}
    return next((c for c in GLOSSARY_CATEGORIES if c in have), "other")


def risks(words: list[str], tokens: list[Token], text: str, found: list[str], cites: bool, category_of: dict[str, str]) -> list[str]:
    """Why words that only one reading has deserve a look."""
    of_terms = [f"domain_{c}" for c in GLOSSARY_CATEGORIES if c != "citation" and any(category_of.get(t) == c for t in found)]
    signs = {
        "number_or_date": bool(numbers(words)),
        "measurement_unit": not UNIT_OF.keys().isdisjoint(words),
        "negation": bool(negations(words)),
        "citation_or_known_name": cites or any(category_of.get(t) == "citation" for t in found),
        "proper_name_or_entity": names_someone(tokens, text),
        **dict.fromkeys(of_terms, True),
        "suspected_repetition": repeat_run(words),
    }
    return [name for name, holds in signs.items() if holds]


#: For words of one reading only: the first risk found decides kind and category.
RISK_KINDS = (
    ("citation_or_known_name", "citation_mismatch", "citation"), ("proper_name_or_entity", "source_only_proper_name", "proper_name"), ("measurement_unit", "unit_mismatch", "unit"),
    ("number_or_date", "number_mismatch", "protocol_number"), ("negation", "negation_mismatch", "negation"),
)
KIND_CATEGORIES = {"unit_mismatch": "unit", "number_mismatch": "protocol_number", "negation_mismatch": "negation", "source_only_proper_name": "proper_name"}


def same_spoken(a: str, b: str) -> bool:
    """Two spellings of the same words: only spaces, hyphens or case differ."""
    flat = lambda t: re.sub(r"[\s\-‐-―]+", "", t).casefold()
    return bool(a and b) and a != b and flat(a) == flat(b)


def differences(apple: str, whisper: str, terms: Terms | None = None, category_of: dict[str, str] | None = None, gap: int = 3) -> list[Difference]:
    """Every difference: classified by its changed words, then units, then risks of one-sided words, citations and terms in this order;
    what is only spelled otherwise counts for little, an adjacent repetition at least for medium."""
    left, right = tokenize(apple), tokenize(whisper)
    a, b = [t.value for t in left], [t.value for t in right]
    codes = sequences.opcodes(a, b)
    category_of = category_of or {}
    out = []
    for number, (i1, i2, j1, j2) in enumerate(sequences.edit_groups(codes, gap), 1):
        changes = [c for c in codes if c[0] != "equal" and i1 <= c[1] and c[2] <= i2 and j1 <= c[3] and c[4] <= j2]
        gone, new = [w for _, s, e, _, _ in changes for w in a[s:e]], [w for *_, s, e in changes for w in b[s:e]]
        kind, severity = rules.classify(gone, new)
        units = [measurement_units(window(t, s, e, UNIT_REACH)) for t, s, e in ((left, i1, i2), (right, j1, j2))]
        if all(units) and units[0] != units[1]:
            kind, severity = "unit_mismatch", "high"
        near = [(gone, window(left, i1, i2, TERM_REACH)), (new, window(right, j1, j2, TERM_REACH))]
        found = list(dict.fromkeys(t for words, nearby in near for t in terms.of_difference(words, nearby))) if terms else []
        cites = any(citation_change(words, nearby) for words, nearby in near)
        only = "apple" if gone and not new else "whisper" if new and not gone else None
        texts = cut(apple, left, i1, i2), cut(whisper, right, j1, j2)
        own, text = (left[i1:i2], texts[0]) if only == "apple" else (right[j1:j2], texts[1])
        reasons = risks(gone or new, own, text, found, cites, category_of) if only else []
        plain = kind in ("wording_difference", "transcription_difference")
        category = ""
        if reasons:
            kind, category = next(((k, c) for r, k, c in RISK_KINDS if r in reasons), ("domain_term_mismatch", glossary_category(found, category_of)))
            severity = "medium" if reasons == ["suspected_repetition"] else "high"
        elif plain and (cites or found):
            kind, severity = "citation_mismatch" if cites else "domain_term_mismatch", "medium"
        category = category or ("citation" if cites else KIND_CATEGORIES.get(kind) or glossary_category(found, category_of))
        if not only and not cites and same_spoken(*texts):
            kind, severity, category = "representation_equivalent", "low", "other"
        spans = ([(s, e) for _, s, e, _, _ in changes if s < e], a), ([(s, e) for *_, s, e in changes if s < e], b)
        repeated = any(where and all(adjacent_duplicate(words, s, e) for s, e in where) for where, words in spans)
        if repeated and severity == "low":
            severity = "medium"
        out.append(Difference(number, kind, severity, category, i1 + 1, i2, j1 + 1, j2, *texts, sequences.ratio(gone, new), found, cites, only, reasons, repeated))
    return out
