"""Sharding by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise, whole_text
from .splitters import plan_ranges, range_of


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every row to one of ``shards`` shards of near equal bytes, equal texts side by side.

    The key is (hash of the text, id). Size-weighted samples of it give splitters; an overfull range is subdivided, which the
    id in the key allows for a text of any number of copies. Inside a range a window gives each row its rank and the bytes
    before it; ranges' totals, a table of bounded size, turn these into positions in the whole table. A row goes to the
    shard in which the middle of its bytes falls, so that shards differ by less than two rows' sizes.

    Law ``bytes``. Size is the UTF-8 length plus 1. Returns id, size, text_crc32, shard, slot (gapless from 0 in key order).
    Null text: size 1, like an empty one. Null ids come first. Repeated rows each get a slot. An empty table gives no row.
    Other columns are not read.
    """
    text = whole_text(text_col)
    slim = materialise(
        docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")),
        "shard-keys",
    )
    n, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = total // max(n, 1) + 1
    keyed = slim.select("h", "id", (F.col("size") + F.lit(mean)).cast("double").alias("cost"))
    splitters = plan_ranges(keyed, ["h", "id"], "cost")
    ranged = slim.withColumn("rng", range_of(["h", "id"], slim.schema, splitters))
    in_range = Window.partitionBy("rng").orderBy("h", "id")
    local = ranged.select(
        "*",
        (F.row_number().over(in_range) - 1).cast("long").alias("rank"),
        (F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
    )
    # One row for each range: MOST_RANGES bounds it, and with it the broadcast.
    totals = ranged.groupBy("rng").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    offsets, rows, size = [], 0, 0
    for r in sorted(totals, key=lambda r: r["rng"]):
        offsets.append((r["rng"], rows, size))
        rows, size = rows + r["n"], size + r["bytes"]
    start = docs.sparkSession.createDataFrame(offsets, "rng int, rows0 long, bytes0 long")
    placed = local.join(F.broadcast(start), "rng").select(
        "id", "size", "text_crc32",
        (F.col("rank") + F.col("rows0")).alias("g"),
        F.least(F.lit(shards - 1), F.floor((2 * (F.col("before") + F.col("bytes0")) + F.col("size")) * shards / F.lit(2 * max(total, 1)))).cast("int").alias("shard"),
    )
    placed = materialise(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("g").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("g") - F.col("first")).alias("slot"))


def op3_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
