"""Sampled splitters: sharding and exact duplicates, by brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexweave.llm import exact_dedup, sharding, splitters

R = random.Random(4)
POOL = ["", None, "a", "a ", "A", "é" * 40, "x" * 5000, "same start of thirty-two characters, end 1", "same start of thirty-two characters, end 2"]
ROWS = [(i * 7 % 311 if i % 50 else None, R.choice(POOL) if R.random() < 0.7 else f"text {i}", "clash", i) for i in range(311)] + [(5, "a", "clash", 0)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, rng string, kept long").repartition(4)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(docs, keep):
    got = exact_dedup.exact_groups(docs, keep=keep).collect()
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(ROWS)
    for r in got:
        t = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[t] if i is not None]
        assert r["group_size"] == len(groups[t])
        assert r["keep_id"] == ((max if keep == "largest" else min)(ids) if ids else None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_groups_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(splitters, "LEAST_RANGES", 40)
    rows = [(i, "hot" if i % 3 else f"t{i % 11}") for i in range(900)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["group_size"] for r in got if r["doc_id"] % 3} == {600}
    assert {r["keep_id"] for r in got if r["doc_id"] % 3} == {899}
    assert sum(r["kept"] for r in got) == 12


def test_carry_keeps_clashing_columns(docs):
    got = exact_dedup.exact_groups(docs, carry=docs.columns).filter("kept").select("row.*")
    assert got.columns == docs.columns and got.filter("rng = 'clash'").count() == got.count()


def test_carry_keeps_null_texts(docs):
    got = exact_dedup.exact_groups(docs, carry=["kept"]).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["row"]["kept"]) for r in got) == sorted((str(i), str(t), k) for i, t, _, k in ROWS)


def test_texts_alike_at_their_start(spark, monkeypatch):
    """One beginning for all rows, so that only hashes and ids can cut ranges; some of the groups are larger than a range."""
    monkeypatch.setattr(splitters, "LEAST_RANGES", 40)
    head = "license " * 8
    rows = [(i, head + (f"one {i % 5}" if i % 2 else f"other {i // 4}")) for i in range(600)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), keep="smallest").collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    of = dict(rows)
    assert all((r["group_size"], r["keep_id"], r["kept"]) == (len(groups[of[r["doc_id"]]]), min(groups[of[r["doc_id"]]]), r["doc_id"] == min(groups[of[r["doc_id"]]])) for r in got) and len(got) == 600


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(none).count() == 0
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("shards", [1, 8])
def test_shards(docs, shards):
    got = sharding.shard(docs, shards).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    size = {}
    for s in range(shards):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        size[s] = sum(r["size"] for r in own)
    most = max(r["size"] for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * most


def test_splitters_part_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(splitters, "LEAST_RANGES", 50)
    df = spark.createDataFrame([(7 if i % 2 else i, i, 1.0) for i in range(4000)], "h long, id long, cost double")
    found = splitters.plan_ranges(df, ["h", "id"], "cost")
    counts = df.groupBy(splitters.range_of(["h", "id"], df.schema, found).alias("r")).count().agg(F.max("count")).first()[0]
    assert len(found) > 30 and counts < 4000 / 50 * 4
    assert all(sum(s <= (h, i) for s in found) == r for h, i, r in df.limit(200).select("h", "id", splitters.range_of(["h", "id"], df.schema, found).alias("r")).collect())
