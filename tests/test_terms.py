"""The search for terms against plain definitions, and how much of it is compared at all."""

import random
from difflib import SequenceMatcher

from lexweave.functions import terms, tokens

R = random.Random(8)


def letters(least, most, alphabet="abcdefgh"):
    return "".join(R.choices(alphabet, k=R.randint(least, most)))


def plain(a, b):
    return round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)


def best(focus, term):
    """The similarity of a focus and a term: of the whole, or of the best window."""
    windows = [focus[i:j] for i, j in tokens.term_windows(focus, len(term.split()))]
    return max((plain(" ".join(w), term) for w in [focus, *windows]), default=0.0) if focus else 0.0


def changed(term):
    """A term with a letter left out, doubled or parted by a space."""
    i = R.randrange(1, len(term))
    return R.choice((term, term[:i] + term[i + 1 :], term[:i] + term[i - 1 :], term[:i] + " " + term[i:])).split()


def cases():
    known = terms.Terms({" ".join(letters(3, 8) for _ in range(R.choice((1, 1, 1, 2, 3)))) for _ in range(120)})
    for _ in range(40):
        sides = [[letters(1, 9) for _ in range(R.randint(0, 5))] for _ in range(2)]
        for side in sides:
            if R.random() < 0.7:
                side[1:1] = changed(R.choice(known.terms))
        yield known, *sides


def test_best_terms_by_brute_force():
    found = 0
    for known, a, b in cases():
        ranked = sorted((-max(x, y), -min(x, y), t, x, y) for t in known.terms for x, y in [(best(a, t), best(b, t))] if max(x, y) >= terms.NEAR)
        assert known.top(a, b) == [(t, -s, x, y) for s, _, t, x, y in ranked[: terms.TOP]]
        found += len(ranked)
    assert found > 30


def test_terms_of_both_sides_by_brute_force():
    found = 0
    for known, a, b in cases():
        b = a[:] if R.random() < 0.3 else b + a[R.randint(0, len(a)) :]
        ranked = sorted((-min(x, y), t) for t in known.terms for x, y in [(best(a, t), best(b, t))] if min(x, y) >= terms.NEAR)
        assert known.both(a, b) == [t for _, t in ranked[: terms.TOP]]
        found += len(ranked)
    assert found > 10


def test_sides_are_searched_once_and_only_if_both_speak():
    known = terms.Terms({letters(6, 9) for _ in range(500)})
    calls, similar = [], known.similar
    known.similar = lambda focus: calls.append(focus) or similar(focus)
    said = [known.terms[5], known.terms[9]]
    assert known.both(said, []) == known.both([], said) == [] and not calls
    assert set(said) <= set(known.both(said, said[:], 500)) and calls == [said]
    assert known.both(["zzzz"], said) == [] and calls == [said, ["zzzz"]]


def test_short_texts_have_the_matchers_ratio():
    for _ in range(3000):
        a = letters(0, 14, R.choice(("ab", "abcd", "aäbß éx")))
        b = "".join(c for c in a if R.random() < 0.8) if R.random() < 0.5 else letters(0, 14, "abé ")
        assert terms.alike(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_windows_without_a_like_term_are_not_searched():
    known = terms.Terms({letters(6, 12, "abcdefghijklmnopqrstuvwxyz") for _ in range(2000)})
    focus = [letters(4, 12, "abcdefghijklmnopqrstuvwxyz") for _ in range(400)]
    known.similar(focus)
    windows = {text for text, _ in known._near if " " in text}
    assert len(windows) < 200  # of 399 of two words, and the whole
