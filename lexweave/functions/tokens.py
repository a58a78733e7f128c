"""Tokens with offsets, folding, and small predicates over words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Fixed values.
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)+(?:[^\W\d_]+)?|\d+|%|[^\W\d_]+(?:['’][^\W_]+)*")
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000, "trillion": 1_000_000_000_000}
UNIT_OF = {
    "kg": "kg", "kgs": "kg", "kilogram": "kg", "kilograms": "kg", "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb", "g": "g", "gram": "g", "grams": "g",
    "mg": "mg", "milligram": "mg", "milligrams": "mg", "mcg": "mcg", "μg": "mcg", "ug": "mcg", "microgram": "mcg", "micrograms": "mcg",
    "kcal": "kcal", "kcals": "kcal", "calorie": "kcal", "calories": "kcal", "cal": "cal", "ml": "ml", "milliliter": "ml", "milliliters": "ml",
    "liter": "l", "liters": "l", "litre": "l", "litres": "l", "percent": "%", "percentage": "%", "%": "%",
}
NEGATIONS = frozenset("no not never none neither nor cannot can't couldn't didn't doesn't don't hadn't hasn't haven't isn't shouldn't wasn't weren't won't wouldn't".split())
FILLERS = frozenset("um uh uhm umm erm er ah oh hmm mm mhm yeah yep yes okay ok so well right like just actually basically literally really and but or then anyway kinda sorta".split())
FILLER_PHRASES = frozenset({("you", "know"), ("i", "mean"), ("kind", "of"), ("sort", "of"), ("i", "guess"), ("you", "see"), ("et", "cetera"), ("i", "think")})
FUNCTION_WORDS = frozenset(
    """a an the this that these those it its i me my we us our you your he him his she her they them their there here is am are was were be been being have has had do does did
    to of in on at for from with by about as into onto over up down out off than then if because so such too very what which who whom when where how all any some each both also only even still yet""".split()
)
COLLOQUIAL = {"gonna": "going to", "wanna": "want to", "gotta": "got to", "cause": "because", "cuz": "because", "kinda": "kind of", "sorta": "sort of"}

WORD_VALUE = dict(zip(SMALL, range(20), strict=True)) | dict(zip(TENS, range(20, 100, 10), strict=True))


class Token(NamedTuple):
    value: str
    original: str
    start: int
    end: int


def fold(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").casefold().replace("’", "'")


@lru_cache(maxsize=1 << 15)
def _value(written: str) -> str:
    word = fold(written)
    if re.fullmatch(r"\d+(?:,\d+)+", word):  # commas part thousands, else one stands for a point
        word = word.replace(",", "") if re.fullmatch(r"\d{1,3}(?:,\d{3})+", word) else word.replace(",", ".") if word.count(",") == 1 else word
    return str(WORD_VALUE[word]) if word in WORD_VALUE else word


def tokenize(text: str | None) -> list[Token]:
    return [Token(_value(m[0]), m[0], m.start(), m.end()) for m in TOKEN.finditer(text or "")]


def words(text: str | None) -> list[str]:
    return [_value(w) for w in TOKEN.findall(text or "")]


def without_fillers(tokens: list[str]) -> list[str]:
    out: list[str] = []
    skip = False
    for i, t in enumerate(tokens):
        if skip:
            skip = False
        elif tuple(tokens[i : i + 2]) in FILLER_PHRASES:
            skip = True
        elif t not in FILLERS:
            out.append(t)
    return out


def colloquial(tokens: list[str]) -> list[str]:
    return [w for t in tokens for w in COLLOQUIAL.get(t, t).split()]


def negations(tokens: list[str]) -> set[str]:
    after = [*tokens[1:], ""]
    return {t for t, n in zip(tokens, after, strict=False) if t in NEGATIONS and not (t == "no" and n in ("cebo", "sebo"))}


def repeat_run(tokens: list[str], least: int = 3, most: int = 8) -> bool:
    """Whether a phrase of two to ``most`` words stands ``least`` times in a row: over a run of equal pairs at that distance."""
    for size in range(2, min(most, len(tokens) // least) + 1):
        run = 0
        for i in range(size, len(tokens)):
            run = run + 1 if tokens[i] == tokens[i - size] else 0
            if run >= size * (least - 1):
                return True
    return False


def adjacent_duplicate(tokens: list[str], start: int, end: int) -> bool:
    span, size = tokens[start:end], end - start
    return size > 0 and span in (tokens[max(0, start - size) : start], tokens[end : end + size])


def term_windows(tokens: list[str], size: int) -> list[tuple[int, int]]:
    """Places of ``size`` words, one less or one more."""
    return [(i, i + n) for n in range(max(1, size - 1), size + 2) for i in range(len(tokens) - n + 1)]
