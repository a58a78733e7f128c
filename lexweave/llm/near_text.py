"""Near duplicates by the true Jaccard similarity of word shingles: SimHash fingerprints first, then an exact search beyond their balls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lean, materialise
from .components import components
from .simhash import bits_of, near_links

#: Shingles of five words; texts are linked at a similarity of 4/5 or more.
WORDS, NUM, DEN = 5, 4, 5
#: One row in so many is read to find common shingles, how often makes one common, and how many are told to the tasks. These
#: decide only in which order a text's shingles are taken, so they change speed but no result.
SAMPLE_EVERY, COMMON_LEAST, COMMON_MOST = 10, 4, 500_000
#: Row groups of tables with shingles, which hold little else than one long column.
GROUP_BYTES = 8 << 20
#: Ids of texts to be read again that are broadcast; more are joined by a shuffle.
ASKED_MOST = 1_000_000


def all_shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Shingles of the lower-cased words as 64-bit hashes, repeats included; of fewer words, one shingle of all. No word: none."""
    found = " ".join(text.lower().split()).encode("utf-8").split()
    h = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [h(b" ".join(found))] if found else []
    else:
        line = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(found) - words] + 1))
        hashes = [h(line[a:b]) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct shingles as sorted signed numbers."""
    return np.unique(all_shingles(text, words).view(np.int64))


def node_of(grams: np.ndarray) -> int:
    """Name of a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of the order (how common, hash): so many that of two texts at the threshold or above one is in both."""
    n = len(grams)
    if not n:
        return grams
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        rank = np.where(common[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, rank))][: n - -(-NUM * n // DEN) + 1]


def parities(grams: np.ndarray) -> np.ndarray:
    """A sketch of one to two bits for each shingle, each bit the parity of how many shingles fall on it. Two texts' sketches, the longer one
    folded to the other's length, differ in no more places than their sets do."""
    lanes = 1 << max(0, (len(grams) - 1) // 64).bit_length()
    bits = np.bincount((grams.view(np.uint64) % np.uint64(64 * lanes)).astype(np.int64), minlength=64 * lanes) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _differ(u: Column, v: Column) -> Column:
    """In how many places two sketches differ; of sizes within the threshold one is at most twice as long as the other."""
    def folded(x: Column, n: Column) -> Column:
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda a, b: a.bitwiseXOR(b))).otherwise(x)

    n = F.least(F.size(u), F.size(v))
    return F.aggregate(F.zip_with(folded(u, n), folded(v, n), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample of rows, sorted, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(shingles(t or "") for t in batch.column(0).to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_EVERY)) == 0).select("text").mapInArrow(lean(run), "gram long, n long")
    top = sample.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "gram").limit(COMMON_MOST).toArrow()
    grams, counts = top.column("gram").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], counts[order]


def _can_be_near(n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
    """Whether two texts whose first common shingle stands at these places can reach the threshold."""
    return (F.least(n - at, other_n - other_at) * (NUM + DEN) >= (n + other_n) * NUM) & (F.least(n, other_n) * DEN >= F.greatest(n, other_n) * NUM)


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, component_id, kept) of every row: the smallest id reachable over pairs of texts with shingles of Jaccard similarity 0.8 or more.

    1. Texts with the same shingles are one node, with a SimHash fingerprint of its shingles. Multi-index hashing finds fingerprints
       that differ in 3 bits or fewer; pairs found are verified by their sets of shingles.
    2. A similarity of 0.8 is about 10 of 64 bits away, beyond any small ball. So a node is also listed under the shingles of its
       prefix, which two nodes at the threshold or above can't fail to share; common shingles come last in it. Under each shingle a node
       is compared with the two ends of the list, and what is near is laid together, so a large group of near copies costs no square.
    3. All pairs under a shingle that are not yet together are compared: no pair at the threshold is lost.

    Sketches rule out most pairs, without a lost one; the others are verified by their whole sets. Null and empty texts, and such
    without a word, are one node. Repeated rows are kept. A null id is carried, and is a component's id only if no other id is there.
    ``kept`` marks the rows of a component's smallest id with, of several texts, the least hash; text_hash is Spark's xxhash64 of the
    text as it is. An empty table gives no row. Other columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    common, counts = _common(rows)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: set[int] = set()
        for batch in batches:
            whole = [all_shingles(t or "") for t in batch.column(1).to_pylist()]
            grams = [np.unique(h.view(np.int64)) for h in whole]
            found, parts = list(map(node_of, grams)), []
            for node, g in zip(found, grams, strict=True):
                # a task lists a node once, however many copies it meets
                parts.append(g[:0] if node in listed else prefix(g, common, counts))
                listed.add(node)
            fps = np.array([bits_of(h) for h in whole], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64()), pa.array(map(len, grams), pa.int64()), pa.array(fps), _lists(parts), _lists(list(map(parities, grams)))],
                names=["id", "h", "node", "n", "fp", "prefix", "bits"],
            )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            grams = {node_of(g): g for g in (shingles(t or "") for t in batch.column(0).to_pylist())}
            fresh = {node: g for node, g in grams.items() if node not in told}
            told.update(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.int64()), _lists(list(fresh.values()))], names=["node", "grams"])

    prints = materialise(rows.mapInArrow(lean(name), f"id {id_type}, h long, node long, n long, fp long, prefix array<long>, bits array<long>"), "prefixes", GROUP_BYTES)
    # texts of one set may repeat shingles differently; one of their fingerprints stands for the node
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    least = prints.select("node", "id", "n", "fp", "bits", first.alias("first")).groupBy("node")
    nodes = materialise(least.agg(F.min("id").alias("least"), F.min("first").alias("first"), F.max("n").alias("n"), F.min("fp").alias("fp"), F.max("bits").alias("bits")), "nodes")
    # dealt by key once: nodes listed by several tasks, and the window, need no other shuffle
    listed = prints.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "key")).repartition("key").dropDuplicates(["key", "node"])
    by_key = Window.partitionBy("key")
    seen = listed.select("*", F.min("node").over(by_key).alias("low"), F.max("node").over(by_key).alias("high"))
    shared = materialise(seen.filter("low <> high"), "shared")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        for c in "uv":
            pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
        alike = F.least("n_u", "n_v") * DEN >= F.greatest("n_u", "n_v") * NUM
        # at the threshold the sets differ in this share of both sizes
        pairs = pairs.filter(alike).filter(_differ(F.col("bits_u"), F.col("bits_v")) * (NUM + DEN) <= (F.col("n_u") + F.col("n_v")) * (DEN - NUM))
        pairs = materialise(pairs.select("u", "v"), "pairs")
        asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        ids = materialise(nodes.join(asked, "node").select("least").distinct(), "asked")
        ids = F.broadcast(ids) if ids.count() <= ASKED_MOST else ids
        sets = materialise(rows.join(ids, rows["id"].eqNullSafe(ids["least"]), "left_semi").select("text").mapInArrow(lean(whole), "node long, grams array<long>"), "sets", GROUP_BYTES)
        a, b = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"of_{c}")) for c in "uv")
        both = pairs.join(a, "u").join(b, "v")
        near = F.size(F.array_intersect("of_u", "of_v")) * (NUM + DEN) >= (F.size("of_u") + F.size("of_v")) * NUM
        # several tasks may have read copies of a node
        return materialise(both.filter(near).select("u", "v").distinct(), "near")

    def together(links: DataFrame) -> DataFrame:
        """``shared`` with the roots that the links give, only under shingles that still part nodes."""
        placed = shared.join(materialise(components(links), "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        parted = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
        return materialise(placed.join(parted, "key"), "placed")

    # fingerprints: nodes of one fingerprint with the least of them, and the least nodes of fingerprints in a ball
    of_print = nodes.groupBy("fp").agg(F.min("node").alias("one"))
    balls = near_links(of_print.select("fp"))
    for c in "uv":
        balls = balls.join(of_print.select(F.col("fp").alias(c), F.col("one").alias(f"node_{c}")), c)
    same = nodes.join(of_print, "fp").select(F.col("node").alias("u"), F.col("one").alias("v"))
    # and the least neighbour of each node
    one = shared.groupBy("node").agg(F.min("low").alias("v")).withColumnRenamed("node", "u")
    links = verified(balls.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).unionByName(same).unionByName(one))
    # both ends of each list that stands in several parts
    placed = together(links)
    ends = placed.select(F.col("root"), F.col("node").alias("u"), F.explode(F.array("low", "high")).alias("v")).distinct()
    root_of = placed.select(F.col("node").alias("v"), F.col("root").alias("root_v")).distinct()
    links = links.unionByName(verified(ends.join(root_of, "v").filter("root <> root_v").select("u", "v")))
    # what still isn't together: of a pair the shorter text is found by its first shingles, which are fewer
    placed = together(links)
    few_first = F.col("at") < F.col("n") - F.ceil(F.col("n") * (2 * NUM) / F.lit(NUM + DEN)) + 1
    long, short = (x.select("key", F.col("root").alias(f"root_{c}"), F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("at").alias(f"at_{c}")) for x, c in ((placed, "u"), (placed.filter(few_first), "v")))
    ordered = (F.col("n_u") > F.col("n_v")) | (F.col("n_u") == F.col("n_v")) & (F.col("u") > F.col("v"))
    rest = long.join(short, (long["key"] == short["key"]) & (F.col("root_u") != F.col("root_v")) & ordered & _can_be_near(F.col("n_u"), F.col("at_u"), F.col("n_v"), F.col("at_v")))
    found = components(links.unionByName(verified(rest.select("u", "v"))))
    # a node without links is its own component, by its least id
    linked = nodes.join(found, "node")
    known = linked.select("node", "root").join(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("of_all")), "root").select("node", "component_id", "of_all")
    of_node = nodes.join(known, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("of_all", "first").alias("of_all"))
    placed = prints.select("id", "h", "node").join(materialise(of_node, "components"), "node")
    kept = F.col("id").eqNullSafe(F.col("of_all.id")) & (F.col("h") == F.col("of_all.h"))
    return placed.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "component_id", kept.alias("kept"))
