"""Texts against a registry of terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from itertools import accumulate
from math import ceil

import numpy as np

from .materiality import Spellings
from .sequences import ratio
from .tokens import term_windows, words

#: The least similarity of a window and of a changed word, how many are kept, and the registry above which the status says
#: that a plain scan is too large. The search doesn't depend on it: registries of any size are searched whole.
NEAR, NEAR_WORD, TOP, REGISTRY_MOST = 0.82, 0.80, 3, 5_000
#: Results kept in memory: of texts with the terms found, a third of which texts alone may have, and of words, in bytes. What isn't kept is
#: searched again.
KEPT_MOST, WORDS_KEPT_BYTES = 600_000, 32_000_000
#: Terms from which on one text is compared with all at once, and characters of a text that this can hold.
AT_ONCE_LEAST, AT_ONCE_CHARS = 80, 64
#: Characters of two texts up to which they are compared without a matcher, which takes longer to make.
SHORT_MOST = 60


def _units(text: Iterable) -> Iterator[tuple]:
    """A text's characters, each with how often it stood before."""
    seen: dict = {}
    for c in text:
        n = seen.get(c, 0)
        seen[c] = n + 1
        yield c, n


def _places(text: str) -> dict[str, int]:
    """A text's characters, each with a bit for every place where it stands."""
    found: dict[str, int] = {}
    for i, c in enumerate(text):
        found[c] = found.get(c, 0) | 1 << i
    return found


def _common(places: dict[str, int], every: int, other: str) -> int:
    """The length of a longest common subsequence, which no match of blocks exceeds. ``every``: a bit for each character of the first text."""
    v = every
    for m in map(places.get, other):
        if m:
            u = v & m
            v = v + u | v - u
    return (~v & every).bit_count()


def _set_of(bits: Iterable[int], size: int) -> int:
    """A whole number with these bits of ``size``."""
    out = bytearray(size + 7 >> 3)
    for b in bits:
        out[b >> 3] |= 1 << (b & 7)
    return int.from_bytes(out, "little")


def _bits_of(found: int) -> np.ndarray:
    """The bits of a whole number, lowest first."""
    octets = np.frombuffer(found.to_bytes(found.bit_length() + 7 >> 3, "little"), np.uint8)
    some = np.flatnonzero(octets)
    at, bit = np.nonzero(np.unpackbits(octets[some, None], axis=1, bitorder="little"))
    return some[at] * 8 + bit


@lru_cache(maxsize=1 << 15)
def _letters(text: str) -> int:
    """A bit for each character and each time that it stands in a text; characters are laid into few slots, equal ones share one."""
    return sum(1 << (slot + 64 * n) for slot, n in _units(ord(c) % 64 for c in text))


def alike(a: str, b: str) -> float:
    """SequenceMatcher's ratio; of short texts by searching for their longest common block, the first one in ``a``, then in ``b``."""
    both = len(a) + len(b)
    if both > SHORT_MOST:
        return SequenceMatcher(None, a, b, autojunk=False).ratio()
    matched, waiting = 0, [(a, b)]
    while waiting:
        x, y = waiting.pop()
        m = len(x)
        for size in range(min(m, len(y)), 0, -1):
            at = -1
            for i in range(m - size + 1):
                at = y.find(x[i : i + size])
                if at >= 0:
                    break
            if at >= 0:
                matched += size
                if i and at:
                    waiting.append((x[:i], y[:at]))
                if i + size < m and at + size < len(y):
                    waiting.append((x[i + size :], y[at + size :]))
                break
    return 2.0 * matched / both if both else 1.0


class Registry:
    """A registry's terms in order, of any number."""

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted({t for t in terms if t.strip()})

    @cached_property
    def spellings(self) -> Spellings:
        return Spellings.of(self.terms)


class Terms(Registry):
    """A registry in memory. Windows are compared with those terms only whose letters and length allow the least similarity.

    Sets of terms are whole numbers with a bit for each term, the longest term the lowest bit, so that sets of long terms are short.
    """

    def __init__(self, terms: Iterable[str]):
        super().__init__(terms)
        self.status = "available" if len(self.terms) <= REGISTRY_MOST else "too_large"
        self.parts = [words(t) for t in self.terms]
        self.joined = [" ".join(p) for p in self.parts]
        self.sizes = sorted({len(p) for p in self.parts})
        self._order = sorted(range(len(self.terms)), key=lambda t: -len(self.joined[t]))
        #: the greatest length of a text that is like a term
        self._widest = int((2 - NEAR) / NEAR * max(map(len, self.joined), default=0) + 1e-6)
        of: dict[tuple[int, int], list[int]] = {}
        having: dict[tuple[str, int], list[int]] = {}
        for bit, t in enumerate(self._order):
            of.setdefault((len(self.joined[t]), len(self.parts[t])), []).append(bit)
            for unit in _units(self.joined[t]):
                having.setdefault(unit, []).append(bit)
        self._of = {kind: _set_of(bits, len(self.terms)) for kind, bits in of.items()}
        self._having = {unit: _set_of(bits, len(self.terms)) for unit, bits in having.items()}
        self._rooms: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        self._words: dict[str, list[int]] = {}
        self._near: dict[tuple[str, int], list[tuple[int, float]]] = {}
        self._words_bytes = self._near_kept = 0

    @cached_property
    def _written(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """All terms in order, end to end: a number from 1 for each character, the terms' characters, and where each begins."""
        joined = [self.joined[t] for t in self._order]
        number = {c: k for k, c in enumerate(sorted(set().union(*joined)), 1)}
        characters = np.fromiter((number[c] for j in joined for c in j), np.uint32)
        return number, characters, np.fromiter(accumulate(map(len, joined), initial=0), np.int64)

    @cached_property
    def _with(self) -> dict[str, list[int]]:
        """The terms that each word is a part of."""
        found: dict[str, list[int]] = {}
        for t, part in enumerate(self.parts):
            for w in set(part):
                found.setdefault(w, []).append(t)
        return found

    def _room(self, length: int, size: int, n: int = 1) -> list[tuple[int, int]]:
        """(most, terms): by length, how many characters a like text of ``length`` and ``n`` words may have that the term lacks, spaces
        that it lacks apart; terms of ``size`` words, or any with 0."""
        key = length, size, n
        if key not in self._rooms:
            found: dict[int, int] = {}
            for (other, parts), terms in self._of.items():
                least = ceil((NEAR * (length + other) - 1e-9) / 2)
                most = length - least - (max(0, n - size) if size else 0)
                if (not size or parts == size) and most >= 0 and least <= other:
                    found[most] = found.get(most, 0) | terms
            self._rooms[key] = sorted(found.items())
        return self._rooms[key]

    def _lacking(self, text: str, most: int, terms: int) -> list[int]:
        """Those of ``terms`` that lack no more than 0, 1, ..., ``most`` of the text's characters."""
        within = [terms] * (most + 1)
        steps = range(most, 0, -1)
        for unit in _units(text):
            has = self._having.get(unit, 0)
            for k in steps:
                within[k] = within[k] & has | within[k - 1]
            within[0] &= has
            if not within[most]:
                break
        return within

    def _word(self, word: str) -> list[int]:
        """``_lacking`` of a word among the terms that a text of it and another word may be like, as far as any such text may lack."""
        found = self._words.get(word)
        if found is None:
            terms = most = 0
            for length in range(len(word) + 2, self._widest + 1):
                for k, some in self._room(length, 0):
                    terms, most = terms | some, max(most, k)
            found = self._lacking(word, most, terms)
            size = 300 + sum(30 + (x.bit_length() >> 3) for x in found)
            if self._words_bytes + size > WORDS_KEPT_BYTES:
                self._words.clear()
                self._words_bytes = 0
            self._words[word] = found
            self._words_bytes += size
        return found

    def _sharing(self, text: str, can: int) -> Iterator[int]:
        """Those of the terms ``can`` whose longest common subsequence with a text allows the least similarity."""
        if can.bit_count() >= AT_ONCE_LEAST and len(text) <= AT_ONCE_CHARS:
            number, characters, begin = self._written
            bits = _bits_of(can)
            sizes = begin[bits + 1] - begin[bits]
            places = np.zeros(len(number) + 1, np.uint64)
            for c, m in _places(text).items():
                places[number.get(c, 0)] = m
            places[0] = 0
            every = np.uint64((1 << len(text)) - 1)
            v = np.full(len(bits), every)
            # by falling length, as the bits are: what is no longer there is at the end
            for i in range(int(sizes[0])):
                n = int(np.searchsorted(-sizes, -i))
                x = v[:n]
                u = x & places[characters[begin[bits[:n]] + i]]
                v[:n] = x + u | x - u
            enough = 2 * np.bitwise_count(~v & every).astype(np.int64) >= NEAR * (len(text) + sizes) - 1e-9
            yield from map(self._order.__getitem__, bits[enough].tolist())
            return
        places, every = _places(text), (1 << len(text)) - 1
        while can:
            bit = can.bit_length() - 1
            can ^= 1 << bit
            t = self._order[bit]
            if 2 * _common(places, every, self.joined[t]) >= NEAR * (len(text) + len(self.joined[t])) - 1e-9:
                yield t

    def near(self, text: str, size: int, among: int = -1) -> list[tuple[int, float]]:
        """(term, similarity) of terms of ``size`` words, or any with 0, that are like a text as a whole. ``among``: terms that include all such."""
        key = text, size
        found = self._near.get(key)
        if found is None:
            can, room = 0, [(k, some & among) for k, some in self._room(len(text), size) if some & among]
            if room:
                every = 0
                for _, some in room:
                    every |= some
                within = self._lacking(text, room[-1][0], every)
                for k, some in room:
                    can |= within[k] & some
            found = [(t, s) for t in self._sharing(text, can) if (s := round(alike(text, self.joined[t]), 6)) >= NEAR] if can else []
            found.sort()
            if self._near_kept + 3 + len(found) > KEPT_MOST:
                self._near.clear()
                self._near_kept = 0
            self._near[key] = found
            self._near_kept += 3 + len(found)
        return found

    def similar(self, focus: list[str]) -> dict[int, float]:
        """Terms like the whole focus, or like a window of it of as many words as the term has, one less or one more."""
        best: dict[int, float] = {}
        if not focus:
            return best
        ends = list(accumulate((len(w) + 1 for w in focus), initial=0))
        found = list(self.near(" ".join(focus), 0)) if ends[-1] - 1 <= self._widest else []
        lacks: list[list[int] | None] = [None] * len(focus)
        for size in self.sizes:
            for n in range(max(1, size - 1), size + 2):
                if n == 1:
                    for w in focus:
                        found += self.near(w, size)
                    continue
                for i in range(len(focus) - n + 1):
                    length = ends[i + n] - ends[i] - 1
                    if length > self._widest:
                        continue
                    # a text lacks at least what each of its words lacks
                    can = 0
                    for k, some in self._room(length, size, n):
                        for at in range(i, i + n):
                            within = lacks[at]
                            if within is None:
                                within = lacks[at] = self._word(focus[at])
                            some &= within[k]
                            if not some:
                                break
                        can |= some
                    if can:
                        found += self.near(" ".join(focus[i : i + n]), size, can)
        for t, s in found:
            if s > best.get(t, 0.0):
                best[t] = s
        return best

    def score(self, focus: list[str], term: int) -> float:
        """Similarity of a focus to one term, also below the least: of the whole, or of the best window. Windows are tried by what their
        letters allow, as long as that is more than the best so far."""
        if not focus:
            return 0.0
        size, length, letters = len(self.parts[term]), len(self.joined[term]), _letters(self.joined[term])
        ends = list(accumulate((len(w) + 1 for w in focus), initial=0))
        shared = list(accumulate(((_letters(w) & letters).bit_count() for w in focus), initial=0))
        bounds = []
        for i, j in [(0, len(focus)), *term_windows(focus, size)]:
            both = ends[j] - ends[i] - 1 + length
            bounds.append((2.0 * min(length, shared[j] - shared[i] + max(0, min(j - i, size) - 1)) / both if both else 1.0, i, j))
        best, places, every = 0.0, _places(self.joined[term]), (1 << length) - 1
        for bound, i, j in sorted(bounds, reverse=True):
            if bound <= best:
                break
            text = " ".join(focus[i:j])
            both = len(text) + length
            if not both or 2.0 * _common(places, every, text) / both > best:
                best = max(best, alike(text, self.joined[term]))
        return round(best, 6)

    def top(self, apple: list[str], whisper: list[str], most: int = TOP) -> list[tuple[str, float, float, float]]:
        """The best terms for a difference: (term, best, first side's, second side's similarity), by the best, then the lesser side, then name."""
        a, b = self.similar(apple), self.similar(whisper)
        best = {t: max(a.get(t, 0.0), b.get(t, 0.0)) for t in a.keys() | b.keys()}
        # a side that isn't like a term is below the other: it decides between equal bests only
        least = sorted(best.values(), reverse=True)[:most][-1:]
        ranked = []
        for t in (t for t, s in best.items() if s >= least[0]):
            left, right = a.get(t) or self.score(apple, t), b.get(t) or self.score(whisper, t)
            ranked.append((-best[t], -min(left, right), self.terms[t], left, right))
        return [(name, -s, left, right) for s, _, name, left, right in sorted(ranked)[:most]]

    def both(self, apple: list[str], whisper: list[str], most: int = TOP) -> list[str]:
        """Terms that both sides support, by the lesser similarity, then name."""
        if not apple or not whisper:
            return []
        a = self.similar(apple)
        b = a if whisper == apple else self.similar(whisper) if a else {}
        return [self.terms[t] for t in sorted(a.keys() & b.keys(), key=lambda t: (-min(a[t], b[t]), self.terms[t]))[:most]]

    def matches(self, tokens: list[str]) -> list[int]:
        """Terms that stand in the tokens: word for word, or, of four letters or more, in most of their words."""
        out = []
        # without a shared word no window is alike
        for t in sorted({t for w in set(tokens) for t in self._with.get(w, ())}):
            part = self.parts[t]
            windows = (tokens[i:j] for i, j in term_windows(tokens, len(part)))
            if any(w == part or len("".join(part)) >= 4 and ratio(w, part) >= NEAR for w in windows):
                out.append(t)
        return out

    def of_difference(self, changed: list[str], nearby: list[str]) -> list[str]:
        """Terms near a difference of which a changed word plausibly is a part."""
        return [self.terms[t] for t in self.matches(nearby) if any(near_word(c, w) for c in changed for w in self.parts[t])]

    def focus(self, tokens: list[str]) -> str | None:
        """The word most like a part of a term; the first of equal ones."""
        best: tuple[float, int] | None = None
        for k, w in enumerate(tokens):
            s = max((s for _, s in self.near(w, 0)), default=0.0)
            if s >= NEAR and (best is None or s > best[0]):
                best = s, k
        return tokens[best[1]] if best else None


def near_word(changed: str, part: str) -> bool:
    """Whether a changed word plausibly is a word of a term: equal, alike, or one the beginning of the other if both are short."""
    short, long = sorted((changed, part), key=len)
    if changed == part:
        return True
    if len(short) >= 4:
        return SequenceMatcher(None, changed, part, autojunk=False).ratio() >= NEAR_WORD
    return len(short) >= 2 and len(long) <= 4 and long.startswith(short)
