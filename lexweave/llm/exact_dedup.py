"""Exact duplicates by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise
from .splitters import cut_by_splitter, plan_ranges, range_of

#: Characters of the text that ranges are cut by; a hash and the id cut among texts that agree in them.
LEAD = 32


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise=lambda text: text, carry: list[str] | None = None) -> DataFrame:
    """Groups of rows whose normalised texts are equal byte by byte.

    1. One pass writes each row's key: the first LEAD characters of its normalised text, the text's 64-bit hash, its id. Size-weighted
       samples of keys give splitters, which may fall inside a group of copies, as the id is part of the key.
    2. Each range is sorted externally by its normalised bytes, then id, and every row's whole text is compared with the one before it;
       equal neighbours are a run. The hash decides about nothing but where ranges are cut.
    3. Runs that a splitter cuts, two for each splitter at most, are joined by their whole texts.

    ``keep``: ``largest`` or ``smallest`` id stays. Null text counts as empty. A null id stays only in a group without
    others. Of rows repeated with one id, one stays. An empty table gives no row. Returns id, keep_id, group_size, kept,
    text_sha256, and with ``carry`` a struct ``row`` of these columns of the row and ``text``, null where it was.
    """
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    row = [F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row"), docs[f"`{text_col}`"].isNull().alias("blank")] if carry is not None else []
    also = ["row", "blank"] if carry is not None else []
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), *row).withColumns({"lead": F.substring("t", 1, LEAD), "h": F.xxhash64("t")})
    key = ["lead", "h", "id"]
    keyed = materialise(rows.select(*key, (F.octet_length("t") + 1000).cast("double").alias("cost")), "exact-keys")
    splitters = plan_ranges(keyed, key, "cost")
    ranged = rows.withColumns({"rng": range_of(key, rows.schema, splitters), "cut": cut_by_splitter(key[:2], rows.schema, splitters)})
    largest = keep == "largest"
    order = Window.partitionBy("rng").orderBy("t", F.col("id").asc_nulls_first() if largest else F.col("id").asc_nulls_last())
    runs = ranged.select("rng", "id", "t", "cut", *also, F.lag("t").over(order).alias("before"), F.lead("t").over(order).alias("after"))
    runs = runs.withColumns({"new": ~F.col("t").eqNullSafe(F.col("before")), "end": ~F.col("t").eqNullSafe(F.col("after"))})
    runs = runs.withColumn("run", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    of_run = Window.partitionBy("rng", "run")
    best: Column = F.max("id") if largest else F.min("id")
    slim = materialise(
        runs.select(
            "rng", "run", "id", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), F.col("end" if largest else "new").alias("best_here"), F.when(F.col("cut") & F.col("new"), F.col("t")).alias("cut_text"),
            *([F.when(~F.col("blank"), F.col("t")).alias("text"), "row"] if carry is not None else []),
        ).withColumns({"n": F.count(F.lit(1)).over(of_run), "best": best.over(of_run)}),
        "exact-runs",
    )
    # parts of runs that splitters cut, bounded by the number of splitters
    parts = slim.filter(F.col("cut_text").isNotNull()).select("rng", "run", F.col("cut_text").alias("t"), "n", "best")
    joined = parts.groupBy("t").agg(F.sum("n").alias("whole_n"), (F.max if largest else F.min)("best").alias("whole_best"), F.collect_list(F.struct("rng", "run")).alias("parts"))
    joined = joined.select(F.explode("parts").alias("p"), "whole_n", "whole_best").select("p.rng", "p.run", "whole_n", "whole_best")
    out = slim.join(F.broadcast(joined), ["rng", "run"], "left")
    keep_id = F.coalesce("whole_best", "best")
    # rows of one text and id never part, so only one run has its best row with the best id of all
    kept = F.col("best_here") & F.col("id").eqNullSafe(keep_id)
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("whole_n", "n").cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), *(["text", "row"] if carry is not None else []))


def op6_content_sort(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = {
    "op6_content_sort": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
