"""Joins, upserts and streams on small tables, against brute force."""

import random

from pyspark.sql import functions as F

from lexweave.operators.ranges import lookback_join, overlap_join
from lexweave.operators.similarity import containment_pairs
from lexweave.operators.upsert import cas_upsert, insert_absent


def test_lookback(spark):
    r = random.Random(1)
    rows = [(i, r.randint(0, 2), r.randint(-50, 90)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, show long, day long")
    got = {(x["id"], x["earlier_id"]) for x in lookback_join(df, df, ["show"], "day", 30).collect()}
    assert got == {(a, b) for a, s, d in rows for b, t, e in rows if s == t and d - 30 <= e < d}


def test_overlaps(spark):
    r = random.Random(2)
    rows = [(i, r.randint(0, 2), s, s + r.randint(0, 40)) for i in range(90) for s in [r.randint(0, 200)]]
    df = spark.createDataFrame(rows, "id long, k long, start long, end long")
    got = sorted((x["id"], x["other_id"]) for x in overlap_join(df, df, ["k"], 16).collect())
    assert got == sorted((a, b) for a, k, s, e in rows for b, l, t, f in rows if k == l and s < f and t < e and s < e and t < f)


def test_containment(spark):
    r = random.Random(3)
    base = [f"w{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}" for _ in range(200)]
    texts = [" ".join(base[:150]), " ".join(base[20:120]), " ".join(base[100:]), "Don't STOP", "", None, " ".join(base[:150])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    grams = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in ((t or "").lower().replace("'", "").split() for t in texts)]
    want = {(i, j) for i, a in enumerate(grams) for j, b in enumerate(grams[:i]) if a and 2 * len(a & b) >= len(a)}
    got = containment_pairs(df).collect()
    assert {(x["id"], x["earlier_id"]) for x in got} == want
    assert sum(x["is_best"] for x in got) == len({i for i, _ in want})


def test_compare_and_set(spark):
    current = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "key string, generation int, value string")
    updates = spark.createDataFrame([("a", 1, 1, "p"), ("a", 1, 2, "q"), ("b", 4, 1, "r"), ("c", None, 1, "s")], "key string, expected int, at int, value string")
    state, refused = cas_upsert(current, updates)
    assert sorted(tuple(x) for x in state.select("key", "generation", "value").collect()) == [("a", 2, "p"), ("b", 5, "y"), ("c", 1, "s")]
    assert sorted((x["key"], x["at"]) for x in refused.collect()) == [("a", 2), ("b", 1)]


def test_insert_absent_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k long, v string")
    new = insert_absent(a, b, ["k"])
    assert [tuple(x) for x in new.collect()] == [(2, "z")]
    assert insert_absent(a.unionByName(new), b, ["k"]).count() == 0


def test_ingest_takes_each_key_once(spark, tmp_path):
    from lexweave.streaming.ingest import ingest

    df = spark.createDataFrame([(1, "a"), (2, None), (1, "a"), (3, "c")], "doc_id long, text string")
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    target = f"{tmp_path}/out"
    for _ in range(2):
        got = ingest(spark, f"{tmp_path}/in", df.schema, "doc_id", "text IS NOT NULL", target)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_admission_stream_equals_the_fold(spark, tmp_path):
    from lexweave.streaming.ingest import admission_stream

    rows = [(k, i, "400.00") for i in range(12) for k in (1, 2)]
    df = spark.createDataFrame(rows, "episode_key long, attempt_id long, usd string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = admission_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("episode_key", "outcome").agg(F.count("*").alias("n")).collect()
    assert sorted((r["episode_key"], r["outcome"], r["n"]) for r in got) == [(1, "admitted", 4), (1, "refused", 8), (2, "admitted", 4), (2, "refused", 8)]


def test_a_closed_ledger_begins_anew(spark, tmp_path):
    from lexweave.streaming.ingest import admission_stream

    rows = [(1, 1, "1500.00"), (1, 2, "200.00"), (1, 3, None), (1, 4, "1500.00")]
    df = spark.createDataFrame(rows, "episode_key long, attempt_id long, usd string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = admission_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert [r["outcome"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("attempt_id").collect()] == ["admitted", "refused", "closed", "admitted"]


def test_absent_null_keys_are_added_once(spark):
    fresh = spark.createDataFrame([(None, "x"), (1, "y")], "k long, v string")
    new = insert_absent(fresh.limit(0), fresh, ["k"])
    assert new.count() == 2 and insert_absent(new, fresh, ["k"]).count() == 0


def test_containment_within_the_reach(spark):
    words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    df = spark.createDataFrame([(1, words, 0), (2, words, 25), (3, words, 60), (4, words, 60)], "id long, text string, at long")
    got = {(r["id"], r["earlier_id"]) for r in containment_pairs(df, reach=30).collect()}
    assert got == {(2, 1)}
    assert {(r["id"], r["earlier_id"]) for r in containment_pairs(df, reach=35).collect()} == {(2, 1), (3, 2), (4, 2)}


def test_staged_files_are_taken_once(spark, tmp_path):
    import json

    from lexweave.streaming.staging import take_staged

    staging, target, index = (f"file://{tmp_path}/{x}" for x in ("staging", "texts", "index"))

    def stage(name, key, text):
        (tmp_path / "staging").mkdir(exist_ok=True)
        (tmp_path / "staging" / f"{name}.json").write_text(json.dumps({"episode_key": key, "text": text}))

    stage("a", "a", "one")
    stage("b", "other", "two")
    stage("c", "c", "")
    refused = take_staged(spark, staging, target, index).collect()
    assert sorted(r["episode_key"] for r in refused) == ["c", "other"]
    assert sorted(p.name for p in (tmp_path / "staging").glob("*.json")) == ["b.json", "c.json"]
    stage("a", "a", "another text for the same key")
    stage("d", "d", "four")
    take_staged(spark, staging, target, index)
    assert {p.name: p.read_text() for p in (tmp_path / "texts").iterdir()} == {"a.txt": "one", "d.txt": "four"}
    assert sorted((r["episode_key"], r["bytes"]) for r in spark.read.parquet(index).collect()) == [("a", 3), ("d", 4)]
    assert sorted(p.name for p in (tmp_path / "staging").glob("*.json")) == ["b.json", "c.json"]
