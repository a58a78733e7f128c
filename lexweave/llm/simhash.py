"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise
from .components import components

WORDS, SEED, DISTANCE = 3, 42, 3
#: Fingerprints have two segments of 32 bits. Of two that differ in 3 bits or fewer, one segment differs in 1 at most.
SEGMENT = 32
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of the text's shingles, repeats included. Without a word: 0."""
    found = text.encode("utf-8").lower().split()
    if not found:
        return 0
    h = xxhash.xxh64_intdigest
    if len(found) < words:
        hashes = [h(b" ".join(found), SEED)]
    else:
        line = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(found) - words] + 1))
        hashes = [h(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    return bits_of(np.array(hashes, np.uint64))


def bits_of(values: np.ndarray) -> int:
    """The bits that are set in over half the 64-bit values; none of no value."""
    if not len(values):
        return 0
    chunks = np.arange(0, len(values), 255)
    counts = np.zeros(64, np.int64)
    for bit in range(8):
        # eight counters of 8 bits in each 64-bit sum; 255 values can't overflow them
        sums = np.add.reduceat((values >> np.uint64(bit)) & _LANES, chunks)
        counts[bit::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(values)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) of every row, fp as a signed long. Null text: 0. Needs no shuffle."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def near_links(nodes: DataFrame) -> DataFrame:
    """(u, v), u < v: pairs of distinct ``fp`` of ``nodes`` that differ in DISTANCE bits or fewer.

    The table holds each fingerprint under each of its two segments; each asks for the Hamming ball of radius 1 about its own
    segment, 33 keys, and what is found is verified by its complete distance. Equal fingerprints are one node, so copies add
    nothing. A pair is found once: under the low segment only if the high one differs in 2 bits or more.
    """
    high, low = F.shiftrightunsigned("fp", SEGMENT), F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    # the key's sign tells the segment

    def ball(segment: Column) -> Column:
        masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT)])
        return F.transform(masks, lambda mask: segment.bitwiseXOR(mask))

    table = nodes.select(F.col("fp").alias("v"), F.explode(F.array(high, -low - 1)).alias("key"))
    asked = nodes.select(F.col("fp").alias("u"), F.explode(F.concat(ball(high), F.transform(ball(low), lambda k: -k - 1))).alias("key"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    once = (asked["key"] >= 0) | (F.bit_count(F.shiftrightunsigned(differ, SEGMENT)) >= 2)
    return asked.join(table, (asked["key"] == table["key"]) & (F.col("u") < F.col("v")) & (F.bit_count(differ) <= DISTANCE) & once).select("u", "v")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable over links of fingerprints.

    Null and empty texts, and such without a word, have fingerprint 0 and are linked like others. Repeated rows are kept.
    A null id is carried, and is a component's id only if no other id is there. An empty table gives no row.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(near_links(nodes))
    # a node without links is its own component, by its least id
    linked = nodes.join(found, nodes["fp"] == found["node"]).select("fp", "root", "least")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    whole = nodes.join(known, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(materialise(whole, "components"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op5_multi_index_simhash(spark, sf_dir: str) -> DataFrame:
    got = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
