"""Media columns: content-addressed payloads in tar shards, and rows that point into them."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, shared_dir

#: A payload is padded with PAD to a multiple of UNIT bytes; an image row has ROW samples of 8 bits.
UNIT, PAD, ROW = 576, b"\xff", 576
#: Bytes of a stored image that hold all of its header; bytes after which a task begins another shard.
HEADER, SHARD_BYTES = 33, 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded to a positive multiple of UNIT, and its length before that."""
    raw = (text or "").encode("utf-8")
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + PAD * (size - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_image(payload: bytes) -> bytes:
    """A grey PNG of 8-bit samples, ROW of them in a line, each line unfiltered."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    plain = np.zeros((len(lines), ROW + 1), np.uint8)
    plain[:, 1:] = lines
    head = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict[str, int]:
    """Metadata from a stored image's first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a stored image")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "channels": {0: 1, 2: 3}[colour]}


def read_image(stored: bytes) -> bytes:
    meta, at, data = read_header(stored), 8, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Counts over the samples: mean and deviation in thousandths, and a histogram of 8 equal bins."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256)
    n = len(samples)
    total, squares = int(counts @ values), int(counts @ (values * values))
    mean = total * 1000 // n
    deviation = int(np.sqrt(max(0.0, (squares * n - total * total) / (n * n))) * 1000)
    return f"mean={mean};std={deviation};hist=" + "/".join(str(int(c)) for c in counts.reshape(8, 32).sum(axis=1))


_INDEX = "id {id}, digest string, n_bytes long, shard string, at long, length long"
_MEDIA = "digest string, shard string, at long, length long, width int, height int, bit_depth int, channels int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every payload into tar shards under ``folder``; returns the index: a row's digest, and where its bytes stand.

    A task writes its own shards, named by stage, partition, attempt and a random part, so that a task that runs again spoils nothing;
    rows name the shards of the attempt that counted. A task stores each digest once; copies in other tasks may be stored again, and
    ``media_columns`` reads one of them. So no payload is shuffled. The index is written before it is used.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        prefix = f"{context.stageId()}-{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex[:12]}"
        known: dict[str, tuple[str, int, int]] = {}
        out, name, at, shards = None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    payload, n = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        if out is None or at >= shard_bytes:
                            if out is not None:
                                out.write(bytes(1024))
                                out.close()
                            name, at, shards = f"{prefix}-{shards}.tar", 0, shards + 1
                            fs.create_dir(root, recursive=True)
                            out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        image = write_image(payload)
                        member = tarfile.TarInfo(f"{digest}.png")
                        member.size = len(image)
                        head = member.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + image + bytes(-len(image) % 512))
                        known[digest] = (name, at + len(head), len(image))
                        at += len(head) + len(image) + -len(image) % 512
                    rows.append((key, digest, n, *known[digest]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "digest", "n_bytes", "shard", "at", "length"])
            if out is not None:
                out.write(bytes(1024))
        finally:
            if out is not None:
                out.close()

    return materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _INDEX.format(id=id_type)), "media-index")


def read_back(index: DataFrame, folder: str, whole: bool = True) -> DataFrame:
    """A row for each digest of ``index``: metadata from a header-only range read and, if ``whole``, what the stored bytes give.

    Reads go in the order of the shards: a task opens a shard once, and reads forward. Without ``whole``, only HEADER bytes of a
    payload are read, and digests and features are null.
    """
    bounded_batches(index.sparkSession, 2_000)
    names = [f.split()[0] for f in _MEDIA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, file = "", None
        for batch in batches:
            rows = []
            for digest, shard, at, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "at", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{root}/{shard}")
                meta = read_header(file.read_at(HEADER, at))
                row = [digest, shard, at, length, meta["width"], meta["height"], meta["bit_depth"], meta["channels"]]
                if whole:
                    stored = file.read_at(length, at)
                    payload = read_image(stored)
                    sha = hashlib.sha256(payload).hexdigest()
                    if sha != digest:
                        raise ValueError(f"{shard} at {at}: the stored bytes aren't those of {digest}")
                    row += [len(payload), sha, zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)]
                else:
                    row += [meta["width"] * meta["height"], None, None, length, None, None]
                rows.append(row)
            kinds = [pa.string() if t == "string" else pa.int32() if t == "int" else pa.int64() for t in (f.split()[1] for f in _MEDIA.split(", "))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        if file is not None:
            file.close()

    # one row for each digest, by an aggregate that combines before its shuffle: where it is stored first
    one = index.groupBy("digest").agg(F.min(F.struct("shard", "at", "length")).alias("p")).select("digest", "p.*")
    placed = one.repartitionByRange("shard", "at").sortWithinPartitions("shard", "at")
    return placed.mapInArrow(run, _MEDIA)


def media_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's payload in tar shards, and what is read back from there.

    Null text counts as empty; its payload is one unit of padding. Equal texts have one digest and equal values in all
    columns. Texts of any length are stored whole; null ids and repeated rows are kept; an empty table writes no shard. Stored
    bytes that don't give the digest again fail the job.
    """
    folder = folder or media_folder(docs.sparkSession)
    index = store(docs, folder, id_col, text_col)
    media = materialise(read_back(index, folder), "media-columns")
    return index.select("id", "digest", "n_bytes").join(media, "digest").withColumnRenamed("id", id_col)


def op4_tar_media(spark, sf_dir: str) -> DataFrame:
    got = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "channels", "shard", "at", "length")
