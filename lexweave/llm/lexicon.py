"""A minimal acyclic transducer: words as a shared-suffix automaton, with lists of ids as outputs, memory-mapped."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def build(entries: Iterable[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Compile (word, ids) entries into arrays.

    The automaton is minimal: states with equal finality and equal outgoing edges are one state, found as sorted words are
    added. Each edge carries how many words sort before those that go through it; the sum along a word's path is the word's
    rank, and its ids stand at that rank. Empty words and repeats of a word are left out.
    """
    items = sorted({w: ids for w, ids in entries if w}.items())
    # A state on the current path: [final, {byte: number of a finished state}].
    register: dict[tuple, int] = {}
    finished: list[tuple[bool, tuple]] = []

    def settle(state: list) -> int:
        key = (state[0], tuple(sorted(state[1].items())))
        if key not in register:
            register[key] = len(finished)
            finished.append(key)
        return register[key]

    path: list[list] = [[False, {}]]
    before = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            number = settle(path.pop())
            path[-1][1][before[len(path) - 1]] = number

    for word, _ in items:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        close(common)
        path.extend([False, {}] for _ in word[common:])
        path[-1][0] = True
        before = word
    close(0)
    root = settle(path[0])
    words_below = np.zeros(len(finished), np.int64)
    keys, targets, skipped = [], [], []
    for number, (final, edges) in enumerate(finished):  # targets are always finished before their sources
        n = int(final)
        for byte, target in edges:
            keys.append(number * 256 + byte)
            targets.append(target)
            skipped.append(n)
            n += int(words_below[target])
        words_below[number] = n
    ids = [i for _, out in items for i in out]
    return {
        "root": np.array([root], np.int64), "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32),
        "skipped": np.array(skipped, np.int32), "final": np.array([f for f, _ in finished], np.uint8),
        "starts": np.cumsum([0, *(len(out) for _, out in items)]).astype(np.int32), "ids": np.array(ids, np.int32),
    }


_ORDER = ("root", "keys", "targets", "skipped", "final", "starts", "ids")
_KINDS = {"root": np.int64, "keys": np.int64, "targets": np.int32, "skipped": np.int32, "final": np.uint8, "starts": np.int32, "ids": np.int32}


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: the arrays' lengths, then each array padded to 8 bytes."""
    head = np.array([len(arrays[k]) for k in _ORDER], np.int64).tobytes()
    return head + b"".join(arrays[k].tobytes() + bytes(-arrays[k].nbytes % 8) for k in _ORDER)


class Lexicon:
    """The automaton over a memory-mapped file, which all workers of a machine share."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        lengths = raw[: 8 * len(_ORDER)].view(np.int64)
        at = 8 * len(_ORDER)
        for name, n in zip(_ORDER, lengths, strict=True):
            size = int(n) * np.dtype(_KINDS[name]).itemsize
            setattr(self, name, raw[at : at + size].view(_KINDS[name]))
            at += size + -size % 8

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for those that the lexicon lacks. All words take their next byte at once."""
        rank = np.zeros(len(words), np.int64)
        if not words or not len(self.keys):
            return rank - 1
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        state = np.full(len(words), self.root[0], np.int64)
        live = np.flatnonzero(lengths > 0)
        rank[lengths == 0] = -1
        depth = 0
        while len(live):
            key = state[live] * 256 + raw[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[live[~hit]] = -1
            live, at = live[hit], at[hit]
            rank[live] += self.skipped[at]
            state[live] = self.targets[at]
            depth += 1
            over = lengths[live] == depth
            ended = live[over]
            rank[ended[self.final[state[ended]] == 0]] = -1
            live = live[~over]
        return rank

    def output(self, rank: int) -> np.ndarray:
        return self.ids[self.starts[rank] : self.starts[rank + 1]]
