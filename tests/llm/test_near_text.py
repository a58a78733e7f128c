"""The near-duplicate stage, against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from lexweave.llm import near_text
from test_simhash import union

R = random.Random(5)


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def kept(rows):
    sets = {i: grams(t) for i, t in rows}
    return set(union(sets, [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]).values())


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        words[R.randrange(len(words))] = f"z{R.randint(0, 999)}"
    return " ".join(words)


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def test_copies_at_similarity_0_8_are_found(spark, monkeypatch):
    line = [f"l{i}" for i in range(30)]
    bases = [[f"w{R.randint(0, 500)}" for _ in range(R.randint(40, 300))] for _ in range(12)]
    texts = ["", None, " \n", "solo", "Solo", "a b c", "a b c d e", "a b c d e f", "É e f g h i", "é E f g h i"]
    texts += [edited(b, R.randint(0, max(1, len(b) // 25))) for b in bases for _ in range(12)]
    texts += [" ".join(line + b[:40]) for b in bases] + [edited(bases[0], 4) for _ in range(40)]
    texts += [" ".join(b[: len(b) * 4 // 5]) for b in bases] + [" ".join(b[:-5]) for b in bases]
    rows = [(i * 31 % 997, t) for i, t in enumerate(texts)]
    want = kept(rows)
    assert stage(spark, rows) == want and 30 < len(want) < len(rows) - 60
    # which shingles count as common changes no result
    monkeypatch.setattr(near_text, "COMMON_LEAST", 10**9)
    assert stage(spark, rows) == want


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(40)]
    # 36 shingles; a copy without its last k words has 36 - k of them
    for k, n in ((7, 1), (8, 2)):
        assert len(stage(spark, [(1, " ".join(words)), (2, " ".join(words[: 40 - k]))])) == n


def test_empty_table(spark):
    assert stage(spark, []) == set()
