"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, lean, slices

#: Hash buckets, embedding width, subword lengths in bytes.
BUCKETS, WIDTH, LENGTHS = 1 << 15, 16, (3, 4)
#: The model is fitted on so many labelled rows of each language, and so many of all, at most (expected), drawn by a hash of the id; whole texts.
TRAIN_ROWS_PER_LANG, TRAIN_ROWS_MOST = 600, 120_000
#: Counts of so many languages are broadcast.
LANGS_BROADCAST = 10_000
EPOCHS, STEPS_LEAST, RATE, SEED = 6, 12_000, 40.0, 5
#: Rejection: each of so many languages is left out once of a model of fewer steps, which sees its texts as foreign ones. The threshold
#: rejects this share of them, but is no higher than this part of what the worst rightly predicted calibration row scores.
FOLDS, FOLD_STEPS, FOREIGN_REJECTED, OWN_MARGIN = 8, 4_000, 0.75, 0.8
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
# Bytes that belong to words keep their value; all others become 0, the word's boundary.
_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = np.arange(128, 256)
_CLASS[97:123] = np.arange(97, 123)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of ``texts``, and the text of each. A subword is 3 or 4 bytes of a lower-cased word, whose start and end count as a byte."""
    parts = [b"\0" + t.lower().encode("utf-8", "replace") + b"\0" for t in texts]
    raw = _CLASS[np.frombuffer(b"".join(parts), np.uint8)]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    inside = raw != 0
    found, owners = [], []
    for n in LENGTHS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        ok = owner[:m] == owner[n - 1 :]
        h = np.full(m, 0x811C9DC5 + n, np.uint32)
        for k in range(n):
            if 0 < k < n - 1:
                ok = ok & inside[k : k + m]
            h = (h ^ raw[k : k + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        at = np.flatnonzero(ok)
        found.append((h[at] % np.uint32(BUCKETS)).astype(np.int32))
        owners.append(owner[at])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class LanguageModel:
    langs: list[str]
    #: Embeddings times output weights: what a subword adds to each language's mean score.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    #: Which buckets the training rows have, and the least share of a text's subwords that must fall on them.
    seen: np.ndarray
    seen_least: float = 0.0

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, a row for each text, and the share of its subwords that training rows have."""
        ids, owner = subwords(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        for j in range(len(self.langs)):
            sums[:, j] = np.bincount(owner, weights=self.table[:, j][ids], minlength=len(texts))
        counts = np.bincount(owner, minlength=len(texts))
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), np.bincount(owner, weights=self.seen[ids], minlength=len(texts)) / np.maximum(counts, 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text. Null, or no letter: ``und``, 0, rejected."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        for a, b in slices([len(texts[i]) for i in at]):
            p, seen = self.scores([texts[i] for i in at[a:b]])
            for i, row, best, share in zip(at[a:b], p, p.argmax(axis=1), seen, strict=True):
                out[i] = (self.langs[best], float(row[best]), bool(row[best] < self.threshold or share < self.seen_least))
        return out


Bag = tuple[np.ndarray, np.ndarray, int]


def train(rows: list[tuple[str, str]]) -> LanguageModel:
    """Fit on (text, language) rows; a fifth of them calibrates. No row: a model that rejects everything."""
    rows = sorted((lang, t) for t, lang in rows if t and _LETTER.search(t))
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0, np.zeros(BUCKETS))
    bags: list[Bag] = []
    for lang, t in rows:
        ids, n = np.unique(subwords([t])[0], return_counts=True)
        if len(ids):
            bags.append((ids, (n / n.sum()).astype(np.float64), langs.index(lang)))
    order = np.random.default_rng(SEED).permutation(len(bags))
    held = [bags[i] for i in (order[: len(bags) // 5] if len(bags) >= 50 else order)]
    fit = [bags[i] for i in (order[len(bags) // 5 :] if len(bags) >= 50 else order)]
    model = _fit(fit, langs, STEPS_LEAST)
    z = _logits(model, held)
    model.temperature = _temperature(z, np.array([b[2] for b in held]))
    own = _scores(z, model.temperature, np.array([b[2] for b in held]))
    foreign = _foreign(fit, held, langs)
    if len(own):
        least = OWN_MARGIN * float(own.min())
        model.threshold = min(least, float(np.quantile(foreign, FOREIGN_REJECTED))) if len(foreign) else min(least, 1 / len(langs))
        # a text of unknown subwords meets as many seen buckets as there are
        shares = np.array([w @ model.seen[ids] for ids, w, _ in held])
        model.seen_least = 0.5 * (float(shares.min()) + min(float(shares.min()), float(model.seen.mean()))) * OWN_MARGIN
    return model


def _fit(bags: list[Bag], langs: list[str], least: int) -> LanguageModel:
    """Embeddings and output weights by stochastic gradient descent over shuffled rows."""
    rng = np.random.default_rng(SEED + 1)
    emb = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    out, bias, seen = np.zeros((WIDTH, len(langs))), np.zeros(len(langs)), np.zeros(BUCKETS)
    epochs = max(EPOCHS, least // max(len(bags), 1))
    steps, done = epochs * max(len(bags), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, w, y = bags[i]
            seen[ids] = 1
            mean = w @ emb[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = 0.5 * (1 - done / steps)
            step = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.05 * rate * p
            emb[ids] -= rate * RATE * w[:, None] * step
            done += 1
    return LanguageModel(langs, (emb @ out).astype(np.float32), bias, 1.0, 0.0, seen)


def _logits(model: LanguageModel, bags: list[Bag]) -> np.ndarray:
    return np.array([w @ model.table[ids] + model.bias for ids, w, _ in bags]).reshape(len(bags), len(model.langs))


def _probabilities(z: np.ndarray, t: float) -> np.ndarray:
    e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
    return e / e.sum(axis=1, keepdims=True)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss. Targets are smoothed by one row in n + 2, so that a sample without an error doesn't call for
    boundless confidence."""

    def loss(t: float) -> float:
        logs = -np.log(np.maximum(_probabilities(z, t), 1e-300))
        smooth = 1 / (len(y) + 2)
        return float((1 - smooth) * logs[np.arange(len(y)), y].mean() + smooth * logs.mean())

    return min((float(t) for t in np.geomspace(0.01, 10, 80)), key=loss)


def _scores(z: np.ndarray, t: float, y: np.ndarray) -> np.ndarray:
    """The best probabilities of rightly predicted rows."""
    p = _probabilities(z, t)
    return p.max(axis=1)[p.argmax(axis=1) == y]


def _foreign(fit: list[Bag], held: list[Bag], langs: list[str]) -> np.ndarray:
    """What texts score that no label of a model is right for: of each language by a model without it. Needs three languages."""
    found = []
    for gone in range(len(langs)) if len(langs) >= 3 else ():
        if gone * FOLDS // len(langs) == (gone - 1) * FOLDS // len(langs) and gone:
            continue  # of many languages FOLDS are left out
        rest = [(ids, w, y - (y > gone)) for ids, w, y in fit if y != gone]
        known = [(ids, w, y - (y > gone)) for ids, w, y in held if y != gone]
        out = [b for b in held if b[2] == gone]
        if rest and known and out:
            model = _fit(rest, langs[:gone] + langs[gone + 1 :], FOLD_STEPS)
            t = _temperature(_logits(model, known), np.array([b[2] for b in known]))
            found.append(_probabilities(_logits(model, out), t).max(axis=1))
    return np.concatenate(found) if found else np.zeros(0)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Train on rows with a label that are not held out, drawn by a hash of the id: TRAIN_ROWS_PER_LANG of each language, fewer of each if
    all languages together would have more than TRAIN_ROWS_MOST. Every language that is drawn is learned."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit("language"), F.col(id_col)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = counts.count()
    if not langs:
        return train([])
    each = min(TRAIN_ROWS_PER_LANG, TRAIN_ROWS_MOST / langs)
    u = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    drawn = u * F.col("n") < each
    if langs <= LANGS_BROADCAST:
        sample = rows.join(F.broadcast(counts), "lang").filter(drawn)
    else:
        # the hashes drawn are as few as the sample, so texts needn't be dealt by language
        hashes = rows.select("lang", "h").join(counts, "lang").filter(drawn).select("lang", "h")
        sample = rows.join(F.broadcast(hashes), ["lang", "h"], "left_semi")
    return train([(r[0], r[1]) for r in sample.select("text", "lang").collect()])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected; columns of these names are replaced.

    Null texts and texts without a letter: ``und``, 0, rejected. Equal scores: the first language by name. Whole texts are
    read, of any length. An empty table stays empty. Needs no shuffle.
    """
    names = ("lang_pred", "lang_score", "lang_rejected")
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*names)
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.predict(batch.column(text_col).to_pylist())
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(lean(run), schema)


def op7_subword_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs)
    got = identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
