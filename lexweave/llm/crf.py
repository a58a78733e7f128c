"""A linear-chain conditional random field over word shapes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LABELS = ("", "email", "ip", "card", "phone", "secret")
#: What a word's shape is made of, with the number of values each part has.
PARTS = {"digits": 10, "letters": 3, "dots": 5, "at": 2, "dash": 2, "paren": 2, "plus": 2, "quote": 2, "other": 2, "hex": 2}
SHAPES = int(np.prod(list(PARTS.values()))) + 1  # the last one stands beyond a line's ends
EDGE = SHAPES - 1
_DIGITS = np.array([0, 1, 2, 3, 4, 5, 5, 5, 5, *[6] * 7, 7, *[8] * 3, 9])  # by the number of digits, 20 or more last
STEPS, RATE, L2, SEED, SENTENCES = 100, 0.2, 2e-3, 3, 400

# Bits of a byte's class: letter, @, -, bracket, quote, other sign, not hexadecimal.
_BITS = np.zeros(256, np.uint8)
for _b in range(33, 256):
    _c = chr(_b)
    if _b >= 128 or _c.isalpha():
        _BITS[_b] = 1 | (0 if _c in "abcdef" else 64)
    elif _c.isdigit():
        pass
    else:
        _BITS[_b] = {"@": 2 | 64, "-": 4 | 64, "(": 8 | 64, ")": 8 | 64, '"': 16, ".": 64, "+": 64, ",": 64}.get(_c, 32 | 64)
_IS_DIGIT = np.zeros(256, np.int32)
_IS_DIGIT[48:58] = 1
_IS_DOT = np.zeros(256, np.int32)
_IS_DOT[46] = 1
_IS_LETTER = (_BITS & 1).astype(np.int32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of UTF-8 bytes, its line, and its shape."""
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    bits = np.bitwise_or.reduceat(_BITS[raw], starts)
    digits = np.add.reduceat(_IS_DIGIT[raw], starts)
    letters = np.add.reduceat(_IS_LETTER[raw], starts)
    dots = np.add.reduceat(_IS_DOT[raw], starts)
    values = (
        _DIGITS[np.minimum(digits, 20)], np.digitize(letters, (1, 3)), np.minimum(dots, 4), bits >> 1 & 1, bits >> 2 & 1, bits >> 3 & 1,
        raw[starts] == 43, bits >> 4 & 1, bits >> 5 & 1, (bits & 64 == 0) & (digits + letters >= 16),
    )
    shape = np.zeros(len(starts), np.int64)
    for value, n in zip(values, PARTS.values(), strict=True):
        shape = shape * n + value
    return starts, ends, line, shape


def _features() -> np.ndarray:
    """For each shape its features: each part's value, and some pairs of parts. A column for each feature."""
    rest, parts = np.arange(SHAPES - 1), {}
    for name, n in reversed(PARTS.items()):
        parts[name] = rest % n
        rest = rest // n
    columns = [np.zeros((SHAPES - 1, n), np.float32) for n in PARTS.values()]
    for column, name in zip(columns, PARTS, strict=True):
        column[np.arange(SHAPES - 1), parts[name]] = 1
    for a, b in (("digits", "letters"), ("digits", "dots"), ("digits", "dash"), ("digits", "paren"), ("digits", "other"), ("at", "dots")):
        pair = np.zeros((SHAPES - 1, PARTS[a] * PARTS[b]), np.float32)
        pair[np.arange(SHAPES - 1), parts[a] * PARTS[b] + parts[b]] = 1
        columns.append(pair)
    body = np.concatenate(columns, axis=1)
    out = np.zeros((SHAPES, body.shape[1] + 1), np.float32)
    out[:-1, :-1] = body
    out[EDGE, -1] = 1
    return out


@dataclass
class Crf:
    #: What the shapes of the word before, the word and the next one add to each label; transitions; first and last labels.
    before: np.ndarray
    own: np.ndarray
    after: np.ndarray
    step: np.ndarray

    def emissions(self, line: np.ndarray, shape: np.ndarray) -> np.ndarray:
        same = np.concatenate((line[1:] == line[:-1], [False]))
        left = np.concatenate(([EDGE], np.where(same[:-1], shape[:-1], EDGE)))
        right = np.where(same, np.concatenate((shape[1:], [EDGE])), EDGE)
        return self.before[left] + self.own[shape] + self.after[right]

    def decode(self, line: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The best labels of all words by Viterbi, over all lines together.

        A word whose margin for label 0 is more than transitions on both sides can make up has label 0 on the best path
        whatever stands beside it. Such words part the chains exactly; what is between them is decoded in batches.
        """
        labels = np.zeros(len(shape), np.int8)
        if not len(shape):
            return labels
        score = self.emissions(line, shape)
        swing = 2 * float(self.step.max() - self.step.min())
        open_ = np.flatnonzero(score[:, 0] - score[:, 1:].max(axis=1) <= swing)
        if not len(open_):
            return labels
        chain = np.concatenate(([True], (np.diff(open_) != 1) | (line[open_[1:]] != line[open_[:-1]])))
        first = open_[chain]
        size = np.diff(np.append(np.flatnonzero(chain), len(open_)))
        order = np.argsort(-size, kind="stable")
        for k in range(0, len(order), 4096):
            at = order[k : k + 4096]
            self._viterbi(score, line, first[at], size[at], labels)
        return labels

    def _viterbi(self, score: np.ndarray, line: np.ndarray, first: np.ndarray, size: np.ndarray, labels: np.ndarray) -> None:
        # a word with label 0 stands before and after a chain, unless its line ends there
        fixed_before = (first > 0) & (line[np.maximum(first - 1, 0)] == line[first])
        last = first + size - 1
        fixed_after = (last + 1 < len(line)) & (line[np.minimum(last + 1, len(line) - 1)] == line[last])
        best = score[first] + np.where(fixed_before[:, None], self.step[0], 0)
        back = []
        for t in range(1, int(size[0])):  # longest first
            live = int(np.searchsorted(-size, -t, side="left"))
            through = best[:live, :, None] + self.step
            back.append(through.argmax(axis=1).astype(np.int8))
            best[:live] = through.max(axis=1) + score[first[:live] + t]
        final = (best + np.where(fixed_after[:, None], self.step[:, 0], 0)).argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            labels[first[:live] + t] = final[:live]
            if t:
                final[:live] = back[t - 1][np.arange(live), final[:live]]


def labelled_table() -> list[list[tuple[str, str]]]:
    """A small labelled table: lines of (word, label). Words are made by rule, as only their shapes count."""
    rng = np.random.default_rng(SEED)

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def letters(n: int, among: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        return "".join(among[i] for i in rng.integers(0, len(among), n))

    def word() -> list[tuple[str, str]]:
        w = letters(int(rng.integers(1, 12)))
        kind = rng.integers(0, 12)
        if kind == 0:
            w = w.capitalize()
        elif kind == 1:
            w += str(rng.choice([".", ",", "!", "?", ":", ";"]))
        elif kind == 2:
            w += str(rng.choice(["***", "###", "$$$", "%%%", "&&&", "!!"]))
        elif kind == 3:
            w = str(rng.choice(["|", "-", "&", "=", "(c)", "--", "…", "é" + w, w.upper(), "(" + w + ")", '"' + w + '"', w + "-" + w, w + "/" + w]))
        elif kind == 4:
            w = str(rng.choice([digits(1), digits(2), digits(4), "20,000", "2.0", "2.0.", "1.2.3", "v" + digits(1), digits(2) + "%", "$" + digits(2), "12:30", "2021-03-04", digits(3) + ",", digits(2) + "th", "#" + digits(5), digits(6), "3.14159", "(" + digits(4) + ")", letters(3) + digits(2)]))
        return [(w, "")]

    def tail() -> str:
        return str(rng.choice(["", "", "", ".", ","]))

    def email() -> list[tuple[str, str]]:
        name = str(rng.choice([letters(5), letters(4) + "." + letters(6), letters(3) + digits(2), letters(2) + "." + digits(2)]))
        return [(name + "@" + letters(5) + digits(int(rng.integers(0, 2))) + "." + str(rng.choice(["com", "org", "example.com", "co.uk"])) + tail(), "email")]

    def ip() -> list[tuple[str, str]]:
        return [(".".join(str(v) for v in rng.integers(0, 256, 4)) + tail(), "ip")]

    def card() -> list[tuple[str, str]]:
        kind = rng.integers(0, 3)
        if kind == 0:
            return [(digits(4), "card") for _ in range(4)]
        return [(digits(16) + tail() if kind == 1 else "-".join(digits(4) for _ in range(4)), "card")]

    def phone() -> list[tuple[str, str]]:
        kind = rng.integers(0, 5)
        if kind == 0:
            return [("+" + digits(1), "phone"), ("(" + digits(3) + ")", "phone"), (digits(3) + "-" + digits(4) + tail(), "phone")]
        if kind == 1:
            return [("(" + digits(3) + ")", "phone"), (digits(3) + "-" + digits(4) + tail(), "phone")]
        if kind == 2:
            return [("+" + digits(2), "phone"), (digits(2), "phone"), (digits(7) + tail(), "phone")]
        return [(("+" + digits(11) if kind == 3 else "-".join((digits(3), digits(3), digits(4)))) + tail(), "phone")]

    def secret() -> list[tuple[str, str]]:
        key = '"' + letters(int(rng.choice([32, 40, 64])), "0123456789abcdef") + '"' + tail()
        return [(str(rng.choice(["token", "key", "secret", "password"])), ""), ("=", ""), (key, "secret")]

    out = []
    for _ in range(SENTENCES):
        line: list[tuple[str, str]] = []
        for _ in range(int(rng.integers(3, 11))):
            line += (word, word, word, email, ip, card, phone, secret)[rng.integers(0, 8)]() if rng.random() < 0.4 else word()
        out.append(line)
    return out


def train(table: list[list[tuple[str, str]]] | None = None) -> Crf:
    """Maximise the conditional likelihood of a labelled table: forward and backward sums over all its lines at once, Adam."""
    table = labelled_table() if table is None else table
    lines = [row for row in table if row]
    shapes = [words_of(np.frombuffer(" ".join(w for w, _ in row).encode(), np.uint8))[3] for row in lines]
    n, t = len(lines), max(map(len, lines))
    k = len(LABELS)
    own = np.full((n, t + 2), EDGE)
    gold = np.zeros((n, t), np.int64)
    mask = np.zeros((n, t), bool)
    for i, (row, s) in enumerate(zip(lines, shapes, strict=True)):
        own[i, 1 : len(s) + 1] = s
        gold[i, : len(s)] = [LABELS.index(label) for _, label in row]
        mask[i, : len(s)] = True
    features = _features()
    f = features.shape[1]
    # a word's features, and those of the words beside it
    x = np.concatenate([features[own[:, :-2][mask]], features[own[:, 1:-1][mask]], features[own[:, 2:][mask]]], axis=1)
    target = np.eye(k, dtype=np.float32)[gold[mask]]
    pairs = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    size = mask.sum(axis=1)
    weights = [np.zeros((3 * f, k), np.float32), np.zeros((k, k))]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for it in range(1, STEPS + 1):
        score = np.zeros((n, t, k))
        score[mask] = x @ weights[0]
        step = weights[1]

        def logsum(v: np.ndarray, axis: int) -> np.ndarray:
            m = v.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis=axis))

        forward, backward = np.zeros((n, t, k)), np.zeros((n, t, k))
        forward[:, 0] = score[:, 0]
        for j in range(1, t):
            forward[:, j] = np.where(mask[:, j, None], logsum(forward[:, j - 1, :, None] + step, 1) + score[:, j], forward[:, j - 1])
        for j in range(t - 2, -1, -1):
            backward[:, j] = np.where(mask[:, j + 1, None], logsum(step + (score[:, j + 1] + backward[:, j + 1])[:, None, :], 2), 0)
        z = logsum(forward[np.arange(n), size - 1], 1)
        marginal = np.exp(forward + backward - z[:, None, None])
        expected = np.zeros((k, k))
        for j in range(t - 1):
            both = forward[:, j, :, None] + step + (score[:, j + 1] + backward[:, j + 1])[:, None, :] - z[:, None, None]
            expected += np.exp(both[pairs[:, j]]).sum(axis=0)
        grads = [x.T @ (marginal[mask].astype(np.float32) - target) / n + L2 * weights[0], (expected - seen) / n + L2 * weights[1]]
        for w, g, (m, v) in zip(weights, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
    tables = [(features @ weights[0][i * f : (i + 1) * f]).astype(np.float32) for i in range(3)]
    return Crf(*tables, weights[1].astype(np.float32))
