"""Locally consistent parsing by recompression: rounds that name runs and pairs of symbols.

Names are 64-bit hashes of what they stand for, so that all tasks name alike without asking each other. A symbol knows the range of
words that decided on it; wherever this range occurs, in any text, the same symbol stands at the same place.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import xxhash

#: Rounds of pairs after the round of runs: symbols of 6 words on average, decided on by 17.
ROUNDS = 6
CACHE_MOST = 400_000
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASES = [(b, U(pow(int(b), -1, 1 << 64))) for b in (_BASE, U(0xD1342543DE82EF95))]


class WordNames(dict):
    """Places of words in two tables of names, which are hashes with different seeds. The first CACHE_MOST words stay; others are named
    anew for each call."""

    def __init__(self) -> None:
        super().__init__()
        self.known = np.zeros((2, CACHE_MOST), U)
        self.passing: list[tuple[int, int]] = []

    def __missing__(self, word: bytes) -> int:
        names = xxhash.xxh64_intdigest(word, 1), xxhash.xxh3_64_intdigest(word, 2)
        at = len(self)
        if at < CACHE_MOST:
            self.known[:, at] = names
            self[word] = at
            return at
        self.passing.append(names)
        return CACHE_MOST + len(self.passing) - 1

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        """Both names of each word."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, n)
        table = np.concatenate((self.known, np.array(self.passing, U).T), axis=1) if self.passing else self.known
        self.passing.clear()
        return table[:, at]


_NAMES = WordNames()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no bit as it was."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@dataclass
class Words:
    """Words of some texts, one after another: names, the text of each, where its text begins and ends."""

    names: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __post_init__(self) -> None:
        self._sums, self._inverse = [], []
        for name, (base, inverse) in zip(self.names, _BASES, strict=True):
            powers, inverses = np.full(len(name) + 1, base, U), np.full(len(name) + 1, inverse, U)
            powers[0] = inverses[0] = 1
            powers, inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
            self._sums.append(np.concatenate((np.zeros(1, U), np.cumsum(name * powers[:-1], dtype=U))))
            self._inverse.append(inverses)

    @property
    def name(self) -> np.ndarray:
        return self.names[0]

    def digest(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """A hash of the words from ``a`` to ``b``, wherever they stand; hashes of different ``which`` have nothing in common."""
        return mix((self._sums[which][b] - self._sums[which][a]) * self._inverse[which][a] + (b - a).astype(U))


def read_words(texts: list[str | None]) -> Words:
    split = [(t or "").encode("utf-8").split() for t in texts]
    size = np.array([len(s) for s in split], np.int64)
    name = _NAMES.of((w for s in split for w in s), int(size.sum()))
    text = np.repeat(np.arange(len(split)), size)
    first = np.cumsum(size) - size
    return Words(name, text, first[text], (first + size)[text], first)


@dataclass
class Symbols:
    """Symbols in order: name, and the words from ``low`` to ``high`` that decided on it. A range beyond its text's ends stands for the end itself."""

    name: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def _beside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the next symbol is of the same text; what the symbol before, and the next one, were decided on."""
        same = np.concatenate((self.text[1:] == self.text[:-1], [False]))
        before = np.where(np.concatenate(([False], same[:-1])), np.concatenate(([0], self.low[:-1])), self.begin - 1)
        after = np.where(same, np.concatenate((self.high[1:], [0])), self.end + 1)
        return same, before, after

    def runs(self) -> Symbols:
        """Every run of equal symbols becomes one. To know that a run ends takes the symbols beside it."""
        if not len(self.name):
            return self
        same, before, after = self._beside()
        joined = same[:-1] & (self.name[1:] == self.name[:-1])
        a = np.flatnonzero(np.concatenate(([True], ~joined)))
        b = np.append(a[1:], len(self.name)) - 1
        size = (b - a + 1).astype(U)
        name = np.where(size > 1, mix(self.name[a] ^ mix(size + U(0x52))), self.name[a])
        return Symbols(name, self.start[a], np.minimum(before[a], self.low[a]), np.maximum(after[b], self.high[b]), self.text[a], self.begin[a], self.end[a])

    def pairs(self, round_: int) -> Symbols:
        """A hash deals names to left and right; a left one followed by a right one become one symbol.

        That they pair takes the two of them; that a left one stays single, the next one; a right one, the one before.
        """
        if not len(self.name):
            return self
        same, before, after = self._beside()
        left = (mix(self.name + U(0xA5A5 + round_)) & U(1)) == 0
        head = left & same & np.concatenate((~left[1:], [False]))
        tail = np.concatenate(([False], head[:-1]))
        at = np.flatnonzero(~tail)
        two = head[at]
        other = np.minimum(at + 1, len(self.name) - 1)
        name = np.where(two, mix(self.name[at] * _BASE + mix(self.name[other] + U(round_))), self.name[at])
        low = np.where(left[at], self.low[at], np.minimum(before[at], self.low[at]))
        high = np.where(two, self.high[other], np.where(left[at], np.maximum(after[at], self.high[at]), self.high[at]))
        return Symbols(name, self.start[at], low, high, self.text[at], self.begin[at], self.end[at])


def parse(words: Words, rounds: int = ROUNDS) -> Symbols:
    at = np.arange(len(words.name))
    symbols = Symbols(words.name, at, at, at + 1, words.text, words.begin, words.end).runs()
    for r in range(1, rounds + 1):
        symbols = symbols.pairs(r)
    return symbols


@dataclass
class Anchors:
    """Intervals of windows. All windows that begin from ``first`` to ``last`` have one anchor, at one side of their middle; ``key`` stands
    for the anchor and the words that all such windows hold, ``context`` for all the words of these and where the anchor is."""

    key: np.ndarray
    context: np.ndarray
    first: np.ndarray
    last: np.ndarray


#: Windows of an interval without a symbol, at most.
ALONE_MOST = 200


def anchors(words: Words, window: int, rounds: int = ROUNDS) -> Anchors:
    """Every window of ``window`` words in exactly one interval.

    A window's anchor is, of the symbols that were decided on inside the window, the one whose name's hash is least, leftmost first: the
    window's words alone say which and where. Windows with the anchor in their first half share half a window of words from it on,
    those with it in their second half as many up to it; the key has these words too, so that what many texts have in common
    over a few words only doesn't bring them together. So equal windows have equal keys, in any text. A window without a
    symbol, as inside a long run, has the hash of its words for a key; equal ones in a row are one interval.
    """
    begins = np.arange(len(words.name))
    begins = begins[begins + window <= words.end] if len(begins) else begins
    if not len(begins):
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(U), none.astype(U), none, none)
    symbols = parse(words, rounds)
    # ranges grow from left to right on both sides, so the symbols inside a window are neighbours
    a = np.searchsorted(symbols.low, begins, "left")
    b = np.searchsorted(symbols.high, begins + window, "right")
    rank = mix(symbols.name)
    best, least = np.full(len(begins), -1), np.full(len(begins), np.iinfo(U).max, U)
    for step in range(max(0, int((b - a).max()))):
        live = np.flatnonzero(a + step < b)
        at = a[live] + step
        better = (rank[at] < least[live]) | (best[live] < 0)
        best[live[better]], least[live[better]] = at[better], rank[at[better]]
    half = window // 2
    late = symbols.start[np.maximum(best, 0)] - begins >= half
    own = np.zeros(len(begins), U)
    alone = np.flatnonzero(best < 0)
    own[alone] = words.digest(begins[alone], begins[alone] + window)
    text = words.text[begins]
    cut = np.concatenate(([True], (text[1:] != text[:-1]) | (best[1:] != best[:-1]) | (late[1:] != late[:-1]) & (best[1:] >= 0) | (own[1:] != own[:-1]) | (begins[1:] != begins[:-1] + 1) | (best[1:] < 0) & (begins[1:] % ALONE_MOST == 0)))
    i = np.flatnonzero(cut)
    first, last, symbol, late, own = begins[i], begins[np.append(i[1:], len(begins)) - 1], best[i], late[i], own[i]
    alone = symbol < 0
    start = np.where(alone, first, symbols.start[np.maximum(symbol, 0)])
    core = words.digest(np.where(alone, first, np.where(late, start - half, start)), np.where(alone, first, np.where(late, start + 1, start + window - half + 1)))
    key = np.where(alone, mix(own ^ U(0xF00D)), mix(symbols.name[np.maximum(symbol, 0)] + mix(core + late.astype(U))))
    context = np.where(alone, words.digest(first, first + window, 1), mix(words.digest(first, last + window, 1) ^ mix((start - first).astype(U) + U(0xC0))))
    return Anchors(key, context, first, last)
