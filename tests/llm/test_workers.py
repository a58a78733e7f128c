"""What a Python worker holds between tasks: nothing that another operator loaded."""

import gc
import weakref

import corpus_pipeline
import public_tokenizers
import pytest
from lexweave.llm import packing
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_holds_no_other_stages_tokenizer(spark, monkeypatch, name):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("the words of this text are in English, number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    found, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *rest, **more: found.append(f) or real(self, f, *rest, **more))
    dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect()
    assert found or name == "exact_dedup"
    monkeypatch.setattr(packing, "TaskContext", type("Here", (), {"get": classmethod(lambda cls: cls()), "partitionId": lambda self: 0}))
    for f in found:
        held = weakref.ref(packing._encoder(PATH))
        assert packing._encoder(PATH) is held()
        assert sum(b.num_rows for b in f(iter([]))) == 0
        gc.collect()
        # packing's own stays for its next task
        assert (held() is None) == (name != "packing")
