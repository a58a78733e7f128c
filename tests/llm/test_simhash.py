"""Fingerprints and their components, by brute force."""

import random

import xxhash

from lexweave.llm import components, simhash

R = random.Random(8)


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for t in ["", "  \n", None, "One", "one TWO", "a b c", "É é\tA\x0bb c d", "x " * 700, " ".join(R.choice("abcdefg") for _ in range(900))]:
        assert simhash.fingerprint(t or "") == plain(t)


def test_components_by_brute_force(spark):
    base = [f"w{R.randint(0, 400)}" for _ in range(300)]
    texts = ["", None, "solo", "a b c"]
    for _ in range(60):
        w = list(base)
        for _ in range(R.randint(0, 3)):
            w[R.randrange(300)] = f"z{R.randint(0, 9)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"q{R.randint(0, 99)}" for _ in range(30)) for _ in range(60)] + ["a b c"] * 3
    rows = [(i * 31 % 997, t, 1) for i, t in enumerate(texts)]
    got = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()
    fp = {i: plain(t) for i, t, _ in rows}
    want = union(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in got} == {i: (fp[i], want[i]) for i in fp}


def test_links_of_any_segments(spark):
    fps = [R.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in R.sample(range(64), k)) for f in fps for k in (1, 2, 3, 4)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert len(got) == len(want) and {(r["u"], r["v"]) for r in got} == want


def test_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(70)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (3, 2)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: 0 for n in range(71)} | {n: 1000 for n in range(1000, 1100)}


def test_empty_table(spark):
    assert simhash.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
