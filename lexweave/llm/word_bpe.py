"""BPE with word ends: encoding by a transducer lexicon and exact merges, and decoding."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon
from .bpe import CACHE_MOST, byte_alphabet, plain
from .common import bounded_batches

#: Python's str.split() cuts at these too; the tokenizer's white space hasn't got them.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


class Merges:
    """The model's vocabulary and ranked merges, applied by the book: the best-ranked pair first, leftmost first."""

    def __init__(self, path: str):
        self.data = json.load(open(path, encoding="utf-8"))
        model = self.data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.alphabet = [byte_alphabet()[b] for b in range(256)]
        self.special = [t["content"] for t in self.data["added_tokens"]]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in self.data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))

    def tokens(self, word: bytes) -> list[str]:
        parts = [self.alphabet[b] for b in word]
        parts[-1] += self.end
        rank = self.rank.get
        while len(parts) > 1:
            best, at = min((rank(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:])))  # noqa: B905
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def ids(self, word: bytes) -> list[int]:
        return [self.vocab[t] for t in self.tokens(word) if t in self.vocab]

    @cached_property
    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of single bytes, inside a word and at its end; the merges' pairs of ids, sorted, their ranks, and what each rank makes."""
        try:
            inside = np.array([self.vocab[c] for c in self.alphabet], np.int64)
            ends = np.array([self.vocab[c + self.end] for c in self.alphabet], np.int64)
            pairs = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in self.rank], np.int64)
            made = np.array([self.vocab[a + b] for a, b in self.rank], np.int64)
        except KeyError:  # a vocabulary without all bytes: word by word
            return None
        order = np.argsort(pairs)
        return inside, ends, pairs[order], order, made

    def ids_of_all(self, words: list[bytes]) -> list[list[int]]:
        """``ids`` of each word. Words of about one length are merged together, one merge of each at a step."""
        out: list[list[int]] = [[] for _ in words]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w).bit_length(), []).append(i)
        for bits, at in by_size.items():
            if self._arrays is None or bits > 6 or len(at) < 8:
                for i in at:
                    out[i] = self.ids(words[i])
            else:
                for k in range(0, len(at), 20_000):
                    self._merge_together(words, at[k : k + 20_000], out)
        return out

    def _merge_together(self, words: list[bytes], at: list[int], out: list[list[int]]) -> None:
        inside, ends, pairs, order, made = self._arrays
        none = len(order)
        rows = np.array(at)
        size = np.array([len(words[i]) for i in at])
        width = int(size.max())
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in at), np.uint8).reshape(len(at), width)
        column = np.arange(width)
        ids = np.where(column < size[:, None] - 1, inside[raw], np.where(column == size[:, None] - 1, ends[raw], -1))

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = left << 32 | right
            k = np.minimum(np.searchsorted(pairs, key), none - 1)
            return np.where((pairs[k] == key) & (left >= 0) & (right >= 0), order[k], none)

        rank = np.full(ids.shape, none, np.int64)
        if width > 1:
            rank[:, :-1] = ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = rank.argmin(axis=1)
            line = np.arange(len(rows))
            value = rank[line, best]
            over = value == none
            if over.any():
                for i, row in zip(rows[over].tolist(), ids[over].tolist(), strict=True):
                    out[i] = row[: row.index(-1)] if -1 in row else row
                keep = ~over
                rows, ids, rank, best, value = rows[keep], ids[keep], rank[keep], best[keep], value[keep]
                if not len(rows):
                    return
                line = np.arange(len(rows))
            shift = np.minimum(column + (column > best[:, None]), width - 1)
            tail = column + (column > best[:, None]) >= width
            ids = np.where(tail, -1, np.take_along_axis(ids, shift, 1))
            rank = np.where(tail, none, np.take_along_axis(rank, shift, 1))
            ids[line, best] = made[value]
            follow = np.where(best + 1 < width, ids[line, np.minimum(best + 1, width - 1)], -1)
            rank[line, best] = ranks(ids[line, best], follow)
            has = np.flatnonzero(best > 0)
            rank[has, best[has] - 1] = ranks(ids[has, best[has] - 1], ids[has, best[has]])


def compile_lexicon(path: str) -> bytes:
    """The tokenizer's frequent words, which are the vocabulary's entries that end a word, with the ids that merging gives."""
    merges = Merges(path)
    back = {c: b for b, c in enumerate(merges.alphabet)}
    words = (bytes(back[c] for c in t[: -len(merges.end)]) for t in merges.vocab if t.endswith(merges.end) and len(t) > len(merges.end))
    return lexicon.to_bytes(lexicon.build((w, merges.ids(w)) for w in words))


#: Names of lexicons that an application has handed out.
_PUBLISHED: set[tuple[str, str]] = set()


def publish_lexicon(spark: SparkSession, path: str) -> str:
    """Compile, write a file and have Spark hand it to every executor. Returns its name there.

    The file is written once for an application, to a folder of this process's own; executors fetch it from the driver.
    """
    raw = compile_lexicon(path)
    name = f"lexicon-{hashlib.sha256(raw).hexdigest()[:32]}.bin"
    key = spark.sparkContext.applicationId, name
    if key not in _PUBLISHED:
        local = os.path.join(tempfile.mkdtemp(prefix="lexweave-"), name)
        with open(local, "wb") as f:
            f.write(raw)
        spark.sparkContext.addFile(local)
        _PUBLISHED.add(key)
    return name


class WordEncoder:
    """Ids and decoded strings of texts, equal to the tokenizers library's.

    White space parts units, which are encoded on their own. A unit that is new goes through the lexicon's automaton piece
    by piece; pieces that the lexicon lacks are merged exactly. Units with characters on which regex engines or case
    tables might differ, and texts with special tokens, go to the library.
    """

    def __init__(self, path: str, lexicon_path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.known = lexicon.Lexicon(lexicon_path)
        self.name = {i: t for t, i in self.merges.vocab.items()}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache: dict[str, tuple[bytes, str]] = {}

    def _library(self, text: str) -> tuple[bytes, str]:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), self.library.decode(ids, skip_special_tokens=False)

    def new_units(self, units: list[str]) -> dict[str, tuple[bytes, str]]:
        out: dict[str, tuple[bytes, str]] = {}
        pieces: dict[str, list[bytes]] = {}
        for u in units:
            if plain(u):
                pieces[u] = [p.encode() for p in self.merges.pattern.findall(u.lower())]
            else:
                out[u] = self._library(u)
        words = list({p for ps in pieces.values() for p in ps})
        ranks = self.known.ranks(words).tolist()
        ids: dict[bytes, list[int]] = {w: self.known.output(r).tolist() for w, r in zip(words, ranks, strict=True) if r >= 0}
        unseen = [w for w, r in zip(words, ranks, strict=True) if r < 0]
        ids |= zip(unseen, self.merges.ids_of_all(unseen), strict=True)
        for u, ps in pieces.items():
            all_ids = [i for p in ps for i in ids[p]]
            out[u] = struct.pack(f"<{len(all_ids)}I", *all_ids), " ".join(map(self.name.__getitem__, all_ids))
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        odd = [any(s in t for s in self.merges.special) or any(c in t for c in _NOT_SPACE) for t in texts]
        units = [[] if o else t.split() for t, o in zip(texts, odd, strict=True)]
        seen: set[str] = set()
        for u in units:
            seen.update(u)
        new = self.new_units(list(seen.difference(self.cache)))
        if len(self.cache) < CACHE_MOST:
            self.cache.update(new)
            table = self.cache
        else:
            table = {u: self.cache[u] for u in seen if u in self.cache} | new
        out = []
        for t, us, o in zip(texts, units, odd, strict=True):
            if o:
                out.append(self._library(t))
                continue
            ids, names = zip(*map(table.__getitem__, us), strict=True) if us else ((), ())
            # a unit without ids, which a vocabulary that lacks some byte can give, adds nothing to the decoded text
            out.append((b"".join(ids), " ".join(filter(None, names))))
        return out


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def encode_words(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, ids (little-endian 32-bit) and decoded text.

    Null counts as empty: no ids, an empty decoded text. Texts of any length are encoded whole, repeated rows each; an
    empty table stays empty; other columns aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    name = publish_lexicon(spark, tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = SparkFiles.get(name)
        if (tokenizer, where) not in _ENCODERS:
            _ENCODERS[tokenizer, where] = WordEncoder(tokenizer, where)
        encoder = _ENCODERS[tokenizer, where]
        for batch in batches:
            got = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([i for i, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)


def op10_transducer_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = encode_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
