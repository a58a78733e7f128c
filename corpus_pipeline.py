"""From raw documents to packed sequences: five stages, each one of the library's training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import materialise
from lexweave.llm.exact_dedup import exact_groups
from lexweave.llm.language import fit_language_model, identify
from lexweave.llm.near_text import near_texts
from lexweave.llm.packing import pack
from lexweave.llm.pii import find_pii

#: Rows that go, or that repeat, are broadcast up to this number; more are joined by a shuffle.
MARKS_MOST = 1_000_000


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id and text, with all other columns beside them as a struct, so that no column's name can clash and the text goes along once."""
    return docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in _others(docs)]).alias("row"))


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("text",)]


def _back(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs``: the text beside the struct, the others from it, some of them changed."""
    return rows.select(*[changed.get(c, F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on the stage's own labelled rows, doesn't reject. A missing label is filled.

    Null and empty texts and those without a letter are rejected. Whole texts of any length are read. Equal texts, equal decisions; repeated
    rows and null ids stay as they are. An empty table, or one without labels, gives no row. Other columns come back as they were,
    whatever their names.
    """
    model = fit_language_model(docs)
    got = identify(_whole(docs), model).filter(~F.col("lang_rejected"))
    return _back(got, docs, lang=F.coalesce(F.col("row").getField("lang"), F.col("lang_pred")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id.

    Null counts as empty, and stays null. Whole texts of any length are compared. Of rows that share text and largest id one stays; a null
    id stays only where no other is. An empty table gives no row. Other columns come back as they were, whatever their names.
    """
    got = exact_groups(docs, carry=_others(docs))
    return _back(got.filter("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more, the one with the smallest id.

    Null and empty texts, and such without a word, are alike. Whole texts of any length are read. Of equal smallest ids the row with the
    least text hash stays, also where an id stands in several groups; of rows that share id and text one stays; a null id stays only where
    no other is. An empty table gives no row. Other columns come back as they were, whatever their names.
    """
    got = near_texts(docs.select("doc_id", "text"))
    # rows with one id and one text can't be told apart by a join: of those that stay one is taken
    marks = got.groupBy(F.col("doc_id").alias("of_id"), "text_hash", "kept").agg(F.count(F.lit(1)).alias("copies"))
    marks = materialise(marks.filter("NOT kept OR copies > 1"), "marks")
    few = marks.count() <= MARKS_MOST
    rows = _whole(docs).withColumn("hash", F.xxhash64("text"))

    def met(marked: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(marked) if few else marked
        return rows.join(side, rows["doc_id"].eqNullSafe(marked["of_id"]) & (rows["hash"] == marked["text_hash"]), how)

    repeated = met(marks.filter("kept"), "left_semi").dropDuplicates(["doc_id", "hash"])
    return _back(met(marks, "left_anti").unionByName(repeated), docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data or of a secret replaced by its kind; n_chars, if it is there, follows the text.

    A null text stays null, an empty one empty. Whole texts of any length are read. Equal texts, equal results; repeated rows and null ids stay.
    An empty table gives no row. Other columns come back as they were, whatever their names.
    """
    got = find_pii(_whole(docs))
    return _back(got, docs, text=F.col("pii_redacted"), n_chars=F.length("pii_redacted").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' tokens and their places in sequences.

    Null and empty texts give the piece of the end's id alone. Whole texts of any length are cut into as many pieces as they need. Repeated
    rows are packed each, null ids carried along. An empty table gives no row. Other columns aren't read.
    """
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]
#: Models and a tokenizer decide; SQL can't express them. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
