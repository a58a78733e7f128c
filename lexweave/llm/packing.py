"""Bounded-space online packing of token ids into sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteLevelEncoder
from .common import bounded_batches, lean, loaded, materialise

#: Tokens of a sequence, windows open at once in a partition, partitions whose leftovers one task merges, and from how much room on a
#: window that is emitted is filled by cutting the piece that fits nowhere.
SEQUENCE, OPEN, FAN_IN, CUT_LEAST = 1024, 64, 8, 32
_PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, win long, ids binary"


def _encoder(path: str) -> ByteLevelEncoder:
    return loaded(("bytes", path), lambda: ByteLevelEncoder(path))


class Packer:
    """A fixed number of open windows. A piece (document, start, ids, total) goes where least room is left after it; if it fits nowhere
    and all windows are in use, the fullest is emitted. If that has room for ``cut_least`` tokens or more, the piece is cut to fill it,
    so no emitted window lacks as many."""

    def __init__(self, size: int, most: int, cut_least: int = CUT_LEAST):
        self.size, self.most, self.cut_least = size, most, cut_least
        self.room: list[tuple[int, int]] = []  # (free, window), sorted
        self.pieces: dict[int, list] = {}
        self.opened = 0

    def add(self, piece: tuple) -> list[list]:
        """Place a piece of less than a sequence; returns the windows that are emitted, two at most."""
        out = []
        doc, start, ids, total = piece
        if len(self.room) == self.most and self.room[-1][0] * 4 < len(ids):
            free, win = self.room.pop(0)
            if free >= self.cut_least:
                self.pieces[win].append((doc, start, ids[: 4 * free], total))
                start, ids = start + free, ids[4 * free :]
            out.append(self.pieces.pop(win))
        length = len(ids) // 4
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, win = self.room.pop(at)
        else:
            free, win = self.size, self.opened
            self.opened += 1
            self.pieces[win] = []
        self.pieces[win].append((doc, start, ids, total))
        if free > length:
            insort(self.room, (free - length, win))
        else:
            out.append(self.pieces.pop(win))
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, sequence: int = SEQUENCE, open_windows: int = OPEN, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of all documents' ids (each followed by ``end_id``) and their places in sequences of at most ``sequence`` tokens.

    Every partition of the input packs its documents online: whole sequences are cut off a document, and its rest goes to
    the open window it fits best. The windows still open at a partition's end are leftovers; groups of ``fan_in``
    partitions concatenate theirs, cut at ``sequence``, and pass on what is left, until one group is left. So the last
    sequence of all is padded, and windows emitted when nothing fitted are, by less than CUT_LEAST tokens. Memory: ``open_windows`` sequences in a
    partition, ``fan_in`` times that in a merge, whatever the input.

    Null or empty text: the piece [end_id]. Null ids are carried on. Repeated rows are packed each. An empty table gives no
    row. Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = _PIECE.format(id=id_type)
    names = [f.split()[0] for f in schema.split(", ")]
    end = end_id.to_bytes(4, "little")

    def rows_of(window: list, sequence_id: int | None, part: int, win: int, keep: bool) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, sequence_id, at, part, win, ids if keep else None
            at += n

    def batch_of(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    spark_schema = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encoder, part = to_arrow_schema(spark_schema), _encoder(tokenizer), TaskContext.get().partitionId()
        packer, emitted = Packer(sequence, open_windows), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text or "") + end
                total = len(ids) // 4
                whole = total // sequence * sequence
                for start in range(0, whole, sequence):
                    rows += rows_of([(doc, start, ids[4 * start : 4 * (start + sequence)], total)], (part << 28) + emitted, part, 0, False)
                    emitted += 1
                for window in packer.add((doc, whole, ids[4 * whole :], total)) if total > whole else ():
                    rows += rows_of(window, (part << 28) + emitted, part, 0, False)
                    emitted += 1
            yield batch_of(rows, arrow)
        left = [r for _, win in packer.room for r in rows_of(packer.pieces[win], None, part, win, True)]
        yield batch_of(left, arrow)

    placed = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run, ("bytes", tokenizer)), schema), "pieces")
    done, left = placed.filter(F.col("sequence_id").isNotNull()), placed.filter(F.col("sequence_id").isNull())
    found, level = [done], 0
    while parts := left.agg(F.max("part")).first()[0]:
        # groups of fan_in partitions until there is only partition 0
        level += 1
        merged = _merged(left.withColumn("part", F.floor(F.col("part") / fan_in).cast("long")), names, spark_schema, sequence, level, parts // fan_in == 0)
        merged = materialise(merged, f"leftovers-{level}")
        found.append(merged.filter(F.col("sequence_id").isNotNull()))
        left = merged.filter(F.col("sequence_id").isNull())
        if parts // fan_in == 0:
            left = None
            break
    if left is not None and parts is not None:
        found.append(materialise(_merged(left, names, spark_schema, sequence, level + 1, True), "leftovers-last"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _merged(left: DataFrame, names: list[str], schema, sequence: int, level: int, last: bool) -> DataFrame:
    """Concatenate a group's leftovers and cut at ``sequence``; the rest is emitted if this is the last level, else passed on."""

    def merge(group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows = sorted(group.to_pylist(), key=lambda r: (r["win"], r["offset"], r["doc_id"] is not None, r["doc_id"], r["start"]))
        part, out, window, room, emitted = (rows[0]["part"] if rows else 0), [], [], sequence, 0

        def put(final: bool) -> None:
            nonlocal window, room, emitted
            at, base = 0, (level << 56) + (part << 28) + emitted
            for doc, start, ids, total in window:
                n = len(ids) // 4
                out.append((doc, start, n, zlib.crc32(ids), total, base if final else None, at, part, 0, None if final else ids))
                at += n
            window, room, emitted = [], sequence, emitted + 1

        for r in rows:
            start, ids = r["start"], r["ids"]
            while ids:
                take = ids[: 4 * room]
                window.append((r["doc_id"], start, take, r["doc_tokens"]))
                start, ids, room = start + len(take) // 4, ids[len(take) :], room - len(take) // 4
                if not room:
                    put(True)
        if window:
            put(last)
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return left.groupBy("part").applyInArrow(merge, schema)


def op8_online_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
