"""Registries of any size are searched whole."""

import random
from difflib import SequenceMatcher
from itertools import islice, product

import pytest

from lexweave.functions import sequences, terms, tokens
from lexweave.plans import python_ops, registry

MANY = 5_300


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A benchmark of ``MANY`` words and three, and conversations that say some of them."""
    at = str(tmp_path_factory.mktemp("sf"))
    made = ["".join(p) for p in islice(product("bcdfg", "aeiou", "klmnp", "aeiou", "rstvz", "aeiou"), MANY)]
    texts = [" ".join(made[i : i + 100]) for i in range(0, MANY, 100)] + ["Creatine. Metformin, hypertrophy"]
    spark.createDataFrame([*enumerate(texts)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    turns = [(1, 0, "user", "some use metformin daily. we take kreatine nightly. they rest at home."), (1, 1, "bot", "take it. the creatine helps. they rest at home."), (2, 0, "user", "the creatin of metformine."), (2, 1, "bot", None), (3, 0, "user", "we heard bakera. he said bokezu now. they heard bokezun then.")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture
def got(spark, sf):
    return lambda name: [tuple(r) for r in registry.queries()[name](spark, sf).orderBy("episode_key", "id", "part").collect()]


def test_registry_is_read_whole(spark, sf):
    terms = python_ops.benchmark_terms(spark, sf)
    assert len(terms) == MANY + 3 and {"creatine", "hypertrophy", "metformin"} <= set(terms)


def test_chosen_readings(got):
    steps = {(e, i, p): (source, step) for e, i, p, source, step in got("al_12")}
    assert steps[1, 1, 1] == ("apple", "registry_term") and len(steps) == 11


@pytest.fixture
def sides(spark, sf):
    """By row, the similarity of both sides' words, changed ones and all, to every term that is like either."""

    def best(focus, term):
        windows = [focus, *(focus[i:j] for i, j in tokens.term_windows(focus, 1))] if focus else []
        match, top = SequenceMatcher(None, "", term, autojunk=False), 0.0
        for text in {" ".join(w) for w in windows}:
            match.set_seq1(text)
            if match.real_quick_ratio() >= 0.5 and match.quick_ratio() >= 0.5:
                top = max(top, round(match.ratio(), 6))
        return top

    known = python_ops.benchmark_terms(spark, sf)

    def scored(changed):
        for r in python_ops.spans(spark, sf).collect():
            a, b = tokens.words(r.apple), tokens.words(r.whisper)
            if changed:
                codes = [c for c in sequences.opcodes(a, b) if c[0] != "equal"]
                a, b = [w for _, i, j, _, _ in codes for w in a[i:j]], [w for *_, i, j in codes for w in b[i:j]]
            yield (r.episode_key, r.id, r.part), [(t, x, y) for t in known for x, y in [(best(a, t), best(b, t))] if max(x, y) >= terms.NEAR]

    return scored


def test_best_terms(got, sides):
    have, found = got("tk_02"), 0
    for row, scores in sides(True):
        ranked = sorted((-max(x, y), -min(x, y), t) for t, x, y in scores)[:3]
        mine = sorted(h[3:6] for h in have if h[:3] == row)
        assert mine == [(k, t, -s) for k, (s, _, t) in enumerate(ranked, 1)]
        found += len(ranked)
    assert found >= 5


def test_every_letter_pattern_is_searched_alike(monkeypatch):
    """One by one and all at once, with much or nothing kept."""
    r = random.Random(5)
    word = lambda most: "".join(r.choices("abcdeé𝒳", k=r.randint(1, most)))
    listed = {" ".join(word(m) for _ in range(r.choice((1, 1, 2, 3)))) for m in (5, 8, 30) for _ in range(150)}
    said = [[word(m) for _ in range(r.randint(1, 4))] for m in (5, 9, 30) for _ in range(40)] + [t.split() for t in sorted(listed)[::9]]
    found = []
    for least, kept in ((10**9, 10**9), (1, 10**9), (1, 0), (24, 900)):
        monkeypatch.setattr(terms, "AT_ONCE_LEAST", least)
        monkeypatch.setattr(terms, "KEPT_MOST", kept)
        monkeypatch.setattr(terms, "WORDS_KEPT_BYTES", kept)
        known = terms.Terms(listed)
        found.append([known.similar(s) for s in said])
        assert kept > 900 or len(known._near) <= 300
    assert found[0] == found[1] == found[2] == found[3] and sum(map(len, found[0])) > 90


def test_terms_of_both_sides(got, sides):
    have, found = {h[:3]: h[3] for h in got("tk_03")}, 0
    for row, scores in sides(False):
        ranked = sorted((-min(x, y), t) for t, x, y in scores if min(x, y) >= terms.NEAR)[:3]
        assert have.pop(row) == ",".join(t for _, t in ranked)
        found += len(ranked)
    assert not have and found >= 5
