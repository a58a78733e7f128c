"""Repeated passages across documents, found by the symbols of recompression."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialise, slices
from .recompress import U, anchors, mix, read_words

WINDOW = 50
# A span is one long: the first word of the first window, how many windows follow it, and a check of the text it is of.
_FOLLOW_BITS, _CHECK_BITS = 8, 22


def _check_of(text: str | None) -> int:
    return zlib.crc32((text or "").encode("utf-8")) & ((1 << _CHECK_BITS) - 1)


def _pack(first: np.ndarray, follow: np.ndarray, check: np.ndarray) -> np.ndarray:
    return (first << (_FOLLOW_BITS + _CHECK_BITS)) | (follow << _CHECK_BITS) | check


def _unpack(spans: np.ndarray, check: int) -> tuple[np.ndarray, np.ndarray]:
    """First word, and number of further windows, of the spans of this text."""
    spans = spans[(spans & ((1 << _CHECK_BITS) - 1)) == check]
    return spans >> (_FOLLOW_BITS + _CHECK_BITS), (spans >> _CHECK_BITS) & ((1 << _FOLLOW_BITS) - 1)


def _known_here(key: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of which the batch itself has an equal one in a smaller document. They are settled; their keys are spread, so that a
    group of any number of copies sends one row for each batch to the task of its key."""
    order = np.lexsort((doc, context, key))
    k, c, d = key[order], context[order], doc[order]
    head = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
    least = d[head][np.cumsum(head) - 1]
    done = np.zeros(len(key), bool)
    done[order] = d > least
    return done, np.where(done, mix(np.arange(len(key)).astype(U) + mix(doc.astype(U))), key)


def _chunks(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    texts = batch.column("text").to_pylist()
    for a, b in slices([len(t or "") for t in texts], most):
        yield a, b, texts[a:b]


def _cut(arrays: list, fields: list, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    n = len(arrays[0])
    for i in range(0, max(n, 1), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + rows], f) for x, f in zip(arrays, fields, strict=True)], names=["key", "context", "id", "span", "done"])


_ROWS = "key long, context long, id long, span long, done boolean"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def _intervals(docs: DataFrame, window: int) -> DataFrame:
    """A row for each interval of windows that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column("id").to_pylist(), np.int64)
            for a, _, texts in _chunks(batch):
                words = read_words(texts)
                found = anchors(words, window)
                of = words.text[found.first] if len(found.first) else found.first
                check = np.array([_check_of(t) for t in texts], np.int64)
                doc = ids[a + of]
                done, key = _known_here(found.key, found.context, doc)
                span = _pack(found.first - words.first[of], found.last - found.first, check[of])
                yield from _cut([key.view(np.int64), found.context.view(np.int64), doc, span, done], _KINDS)

    return docs.mapInArrow(run, _ROWS)


def _single_windows(asked: DataFrame, window: int) -> DataFrame:
    """A row for each window of the intervals in ``asks`` (key, span): key and hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            asks = batch.column("asks")
            for a, _, texts in _chunks(batch):
                words = read_words(texts)
                keys, hashes, docs, spans = [], [], [], []
                for i, text in enumerate(texts):
                    check = _check_of(text)
                    own = asks[a + i].values
                    if own is None:
                        continue
                    packed = own.field("span").to_numpy(zero_copy_only=False)
                    first, follow = _unpack(packed, check)
                    key = own.field("key").to_numpy(zero_copy_only=False)[(packed & ((1 << _CHECK_BITS) - 1)) == check]
                    size = follow + 1
                    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                    begin = at + int(words.first[i])
                    keys.append(np.repeat(key, size))
                    hashes.append(words.digest(begin, begin + window, 1))
                    docs.append(np.full(len(at), ids[a + i], np.int64))
                    spans.append(_pack(at, np.zeros_like(at), np.full_like(at, check)))
                if keys:
                    key, context, doc, span = np.concatenate(keys).view(U), np.concatenate(hashes), np.concatenate(docs), np.concatenate(spans)
                    done, key = _known_here(mix(key + mix(context)), context, doc)
                    yield from _cut([key.view(np.int64), context.view(np.int64), doc, span, done], _KINDS)

    return asked.mapInArrow(run, _ROWS)


def _settled(rows: DataFrame, more: bool) -> DataFrame:
    """Rows with ``covered``: a smaller document has the same key and context. With ``more``, ``split``: the key has other contexts too."""
    by_key, by_both = Window.partitionBy("key"), Window.partitionBy("key", "context")
    if more:
        rows = rows.withColumn("split", ~F.col("done") & (F.min("context").over(by_key) != F.max("context").over(by_key)))
    return rows.withColumn("covered", F.col("done") | (F.col("id") > F.min("id").over(by_both)))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What a smaller document has too, as (id, span) rows: whole intervals, and single windows. ``docs``: id (long, not null), text.

    1. Recompression puts every window into the interval of its anchor symbol. Intervals equal in symbol and in all words around it are
       settled at once: all but the smallest document's are covered. The symbol's name and the hash of the words come from two
       hashes of each word with different seeds, so what is taken for equal agrees in 128 bits that have nothing in common.
    2. A symbol that stands in different contexts may still share some windows. For one document of each such context (its
       smallest) the interval's windows are compared one by one.
    """
    found = materialise(_settled(_intervals(docs, window), more=True).filter("covered or split").select("key", "id", "span", "covered"), "intervals")
    asks = found.filter("not covered").groupBy("id").agg(F.collect_list(F.struct("key", "span")).alias("asks"))
    asked = docs.join(asks, "id").select("id", "text", "asks")
    singles = _settled(_single_windows(asked, window), more=False).filter("covered").select("id", "span")
    return found.filter("covered").select("id", "span"), singles


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with n_words, n_removed and the kept text: its words less those in a window that begins in a smaller document too.

    Words are runs of bytes other than ASCII white space; kept ones are joined by one space. Windows are judged on the input.
    Null and empty texts have no words. A row with a null id is left as it is, and none of its windows counts against others.
    Repeated rows (one id, one text) get equal results; rows of one id never cover each other. Ids are integers. Memory of a
    task follows its longest text. An empty table gives no row. Other columns aren't read.
    """
    if not 1 <= window < 1 << _FOLLOW_BITS:
        raise ValueError(f"window must be from 1 to {(1 << _FOLLOW_BITS) - 1}")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = rows.filter(F.col("id").isNotNull())
    whole, singles = repeated_spans(known, window)
    spans = whole.unionByName(singles).groupBy("id").agg(F.collect_list("span").alias("spans"))
    nowhere = F.lit(None).cast(T.ArrayType(T.LongType())).alias("spans")
    joined = known.join(spans, "id", "left").select("id", "text", "spans").unionByName(rows.filter(F.col("id").isNull()).select("id", "text", nowhere))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, total, gone, kept = batch.column("spans"), [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = (text or "").encode("utf-8").split()
                own = spans[i].values
                removed = 0
                if own is not None and len(own):
                    first, follow = _unpack(own.to_numpy(zero_copy_only=False), _check_of(text))
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, np.minimum(first + follow + window, len(words)), -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    removed = len(words) - int(keep.sum())
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    left = words
                total.append(len(words))
                gone.append(removed)
                kept.append(b" ".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def op9_recompression(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
