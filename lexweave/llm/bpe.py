"""BPE with the files of public tokenizers: fast exact encoders behind caches of a bounded size."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Entries that a worker's cache keeps, the first seen; later units are encoded each time.
CACHE_MOST = 400_000
#: Letters up to here behave alike in all regex engines and case tables; other units go to the tokenizers library.
_PLAIN_MOST = 0x24F
_ODD = frozenset("İŉǰ\x1c\x1d\x1e\x1f\x85\xa0")


def plain(unit: str) -> bool:
    return (unit.isascii() or ord(max(unit)) <= _PLAIN_MOST) and _ODD.isdisjoint(unit)


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteLevelEncoder(dict):
    """Ids of whole texts, as little-endian 32-bit bytes, equal to those of the tokenizers library.

    A text is cut at single spaces before a character that isn't white space; the library's pre-tokenizer always starts a
    token at such a space, so each unit is encoded on its own. A dict maps a unit to its ids, or to None if it ends in white
    space and so isn't independent; such texts, and those with special tokens in them, go to the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        data = json.load(open(path, encoding="utf-8"))
        back = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in data["model"]["vocab"].items() if all(c in back for c in token)}
        added = {t["content"] for t in data["added_tokens"]}
        self.special = [s for s in added]
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def _encode(self, text: str) -> bytes:
        ids = self.fast(text) if plain(text) else self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes | None:
        got = None if not unit or unit[0].isspace() or unit[-1].isspace() else self._encode(" " + unit)
        if len(self) < CACHE_MOST:
            self[unit] = got
        return got

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._encode(text) if plain(text) else self.whole(text)
        try:
            return self._encode(first) + b"".join(map(self.__getitem__, rest))
        except TypeError:  # a None: some unit isn't independent
            return self._encode(text) if plain(text) else self.whole(text)
