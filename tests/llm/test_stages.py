"""Each stage of the pipeline on odd rows: nulls, empty and long texts, ties, repeated rows and ids, clashing names, empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

WORDS = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
NEAR = WORDS.replace("wordza", "changed")
ROWS = [
    (1, WORDS, "en", 1, "a"), (5, NEAR, "en", 2, "b"), (5, "quite another text of a document with the same number", "en", 3, "c"), (5, NEAR, "en", 2, "b"), (7, None, None, None, "d"), (8, "", "en", 0, "e"),
    (9, " \n\t", "en", 3, "f"), (10, "12 34 56", "en", 8, "g"), (None, "a row without a number but with words", "en", 1, "h"), (11, "long text of many words " * 20_000, "en", 9, "i"), (12, "mail me at jo@example.org or 10.0.0.1", "en", 5, "j"),
    (13, "mail me at jo@example.org or 10.0.0.1", "en", 5, "k"), (14, "the label is missing here and the words are English", None, 5, "l"),
]
SCHEMA = "doc_id long, text string, lang string, n_chars long, row string"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    more = [(100 + i, f"the words of sentence number {chr(97 + i)} are in English and the text is for the model", "en", 1, "m") for i in range(20)]
    odd = spark.createDataFrame(ROWS + more, SCHEMA).repartition(3)
    # names that the stages use themselves
    return odd.select("*", *[F.lit("clash").alias(c) for c in ("hash", "kept_id", "kept", "text_hash", "id", "t", "rng", "blank", "lang_pred", "pii_redacted", "node", "component_id")])


def rows(df):
    return sorted((str(r["doc_id"]), str(r["text"]), r["row"]) for r in df.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, docs, name):
    out = STAGES[name](spark, docs.limit(0), "")
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_come_back(spark, docs, name):
    out = STAGES[name](spark, docs, "")
    assert out.columns == docs.columns and out.filter("hash <> 'clash' OR kept <> 'clash' OR rng <> 'clash'").count() == 0


def test_language(spark, docs):
    out = STAGES["language_id"](spark, docs, "").collect()
    assert {r["row"] for r in out} == {*"abcghijklm"} - {"g"} and all(r["lang"] for r in out)
    assert sum(r["row"] == "b" for r in out) == 2


def test_exact(spark, docs):
    out = rows(STAGES["exact_dedup"](spark, docs, ""))
    assert sum(r[2] == "b" for r in out) == 1 and [r[2] for r in out if r[2] in "de"] == ["e"] and [r[2] for r in out if r[2] in "jk"] == ["k"]
    assert {r[2] for r in out} == {*"abcefghiklm"}


def test_near(spark, docs):
    out = rows(STAGES["near_dedup"](spark, docs, ""))
    # 1 and the two rows of 5 that are near it are one group; the other text of number 5 is its own
    assert [r[2] for r in out if r[2] in "abc"] == ["a", "c"]
    # null, empty and white space are alike, and the least number stays
    assert [r[2] for r in out if r[2] in "def"] == ["d"] and [r[2] for r in out if r[2] in "jk"] == ["j"]
    assert {*"ghil"} <= {r[2] for r in out}


def test_pii(spark, docs):
    out = {r["row"]: r for r in STAGES["pii"](spark, docs, "").collect()}
    assert out["j"]["text"] == "mail me at <EMAIL> or <IP>" and out["j"]["n_chars"] == len(out["j"]["text"])
    assert out["d"]["text"] is None and out["d"]["n_chars"] is None and out["e"]["text"] == ""
    assert len(out["i"]["text"]) == len(ROWS[9][1])


def test_packing(spark, docs):
    out = STAGES["packing"](spark, docs, "").collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert set(by_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [(r["start"], r["length"]) for r in by_id[7]] == [(0, 1)] == [(r["start"], r["length"]) for r in by_id[8]]
    assert sum(r["length"] for r in by_id[11]) == by_id[11][0]["doc_tokens"] > 100_000
    assert sum(r["length"] for r in by_id[5]) == sum(r["doc_tokens"] for r in by_id[5] if r["start"] == 0)
