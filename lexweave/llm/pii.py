"""Personal data: fixed patterns, and spans that a conditional random field adds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import bounded_batches, lean, slices
from .pii_base import KINDS, base_spans

Span = tuple[str, int, int]
_ADDRESS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
#: Versions, decimals, and postal codes with an extension.
_OTHER_NUMBERS = re.compile(r"v?[0-9]{1,2}(?:\.[0-9]+){2,}|[0-9]+\.[0-9]+|[0-9]{5}-[0-9]{4}")
#: Signs that belong to the sentence, not to the span, at a found span's ends.
_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{", ".,;:!?\"'>]}"


def model_spans(model: crf.Crf, texts: list[str]) -> list[list[Span]]:
    """Spans of each text by the model: neighbouring words of one label in one line."""
    out: list[list[Span]] = [[] for _ in texts]
    parts = [t.encode("utf-8") + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    begins = np.cumsum([0, *map(len, parts)])
    starts, ends, line, shape = crf.words_of(raw)
    labels = model.decode(line, shape)
    found = np.flatnonzero(labels)
    if not len(found):
        return out
    joined = (np.diff(found) == 1) & (labels[found[1:]] == labels[found[:-1]]) & (line[found[1:]] == line[found[:-1]])
    heads = found[np.concatenate(([True], ~joined))]
    tails = found[np.concatenate((~joined, [True]))]
    owner = np.searchsorted(begins, starts[heads], side="right") - 1
    known: tuple[int, np.ndarray] | None = None
    for i, a, b, label in zip(owner.tolist(), starts[heads].tolist(), ends[tails].tolist(), labels[heads].tolist(), strict=True):
        if known is None or known[0] != i:
            # code points before each byte of this text
            own = raw[begins[i] : begins[i + 1]]
            known = i, np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
        a, b = int(known[1][a - begins[i]]), int(known[1][b - begins[i]])
        piece = texts[i][a:b]
        a += len(piece) - len(piece.lstrip(_TRIM_LEFT))
        b -= len(piece) - len(piece.rstrip(_TRIM_RIGHT))
        kind = plausible(crf.LABELS[label], texts[i][a:b])
        if kind:
            out[i].append((kind, a, b))
    return out


def _is_book_number(digits: str) -> bool:
    return len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(d) * (1, 3)[i % 2] for i, d in enumerate(digits)) % 10 == 0


def plausible(kind: str, piece: str) -> str | None:
    """The kind that a span found by shapes can be: shapes know no numbers, so an address with a part above 255 is a phone number, if it has
    as many digits as one, or nothing; numbers of books, versions, decimals and postal codes are nothing."""
    digits = "".join(c for c in piece if c in "0123456789")
    if kind == "ip" and not (_ADDRESS.fullmatch(piece) and all(int(p) <= 255 for p in piece.split("."))):
        kind = "phone"
    if kind == "phone":
        return kind if 7 <= len(digits) <= 15 and piece.count(".") <= 4 and not _OTHER_NUMBERS.fullmatch(piece) and not _is_book_number(digits) else None
    if kind == "card":
        return kind if 12 <= len(digits) <= 19 and not _is_book_number(digits) else None
    if kind == "email":
        return kind if "@" in piece.strip("@") else None
    if kind == "secret":
        return kind if len(piece) >= 16 else None
    return kind if piece else None


def all_spans(model: crf.Crf, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. The model's spans are added where they meet no base span."""
    added = [s for a, b in slices([len(t) for t in texts]) for s in model_spans(model, texts[a:b])]
    out = []
    for text, more in zip(texts, added, strict=True):
        base = base_spans(text)
        # spans of different kinds may overlap; a span is free if none of them reaches into it
        free = [s for s in more if not any(a < s[2] and s[1] < b for _, a, b in base)] if base else more
        out.append((base, sorted(base + free, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in angle brackets; of overlapping ones, one mark for them all."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def show(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_COLUMNS = (("base", _SPANS), ("spans", _SPANS), ("redacted", T.StringType()))


def find_pii(docs: DataFrame, model: crf.Crf | None = None, text_col: str = "text", redacted: bool = True) -> DataFrame:
    """``docs`` with pii_base, pii_spans (kind, start, end in code points, end exclusive) and pii_redacted.

    Columns of these names are replaced. Null text counts as empty: no spans, and a null stays null when redacted. Whole
    texts of any length are read in time about proportional to it; repeated rows each get their spans; an empty table stays
    empty. Needs no shuffle. ``redacted=False`` leaves the redacted text null.
    """
    names = [f"pii_{n}" for n, _ in _COLUMNS]
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, (_, kind) in zip(names, _COLUMNS, strict=True))])
    shared = spark.sparkContext.broadcast(model or crf.train())
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            got = all_spans(shared.value, [t or "" for t in texts])
            marked = [redact(t, s) if redacted and t is not None else None for t, (_, s) in zip(texts, got, strict=True)]
            new = [pa.array([rows(b) for b, _ in got], item), pa.array([rows(s) for _, s in got], item), pa.array(marked, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(lean(run), schema)


def _shown(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_crf_pii(spark, sf_dir: str) -> DataFrame:
    got = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), redacted=False).drop("text")

    def count(kind: str):
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:4]]
    return got.select("doc_id", *counts, F.sha2(_shown("pii_base").cast("binary"), 256).alias("base_sha256"), _shown("pii_spans").alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(show(base_spans(text)).encode()).hexdigest()
