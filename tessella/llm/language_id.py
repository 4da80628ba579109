"""Operator 3, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are letter n-grams of one to three code points (blanks mark word edges),
hashed into 2**BITS places, weighted by log counts and inverse document frequency
and scaled to length one. The model is trained by follow-the-regularised-leader
with elastic-net penalties (per-coordinate steps; the L1 part leaves weights at
zero), and a temperature fitted on rows set aside calibrates its scores. Fitting
uses at most SAMPLE labelled documents (the smallest by a hash of the id);
prediction reads whole texts of all documents.

Defined results: ``und`` with score 0 for texts that are null or have no letter;
without labelled rows every text is ``und``; with one language it is always
predicted, with score 1; repeated rows get equal results; equal scores go to the
first language by name; very long texts are counted whole; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, least_by_hash, once, table, text_batches

#: Bound of the labelled sample that is fitted.
SAMPLE = 6_000
BITS, EPOCHS = 15, 3
STEP, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=1)
def _inside() -> np.ndarray:
    """By code point: whether it belongs to words (letters, marks and the apostrophe)."""
    return np.fromiter((unicodedata.category(chr(k))[0] in "LM" or k == 39 for k in range(0x110000)), bool, 0x110000)


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """How often each hashed n-gram occurs in a whole text; what is in no word counts as one blank between words."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    word = _inside()[x]
    word[0] = True  # the first blank stays
    x = np.where(word, x, np.uint32(32))[word | np.append(True, word[:-1])]
    x = x[1:] if len(x) > 1 and x[1] == 32 else x
    x = x if len(x) > 1 and x[-1] == 32 else np.append(x, np.uint32(32))
    m = np.uint32(0x9E3779B1)
    a = (x + np.uint32(0x51ED)) * m
    b = (a[:-1] ^ (x[1:] + np.uint32(0x2C1B))) * np.uint32(0x85EBCA6B)
    c = (b[:-1] ^ (x[2:] + np.uint32(0x7F4A))) * np.uint32(0xC2B2AE35)
    h = np.concatenate([a, b, c])
    return np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(32 - bits), minlength=1 << bits)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # places x languages
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    heat: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        n = counts(text)
        at = np.flatnonzero(n)
        x = (1 + np.log(n[at])) * self.idf[at]
        return at, x / max(float(np.sqrt(x @ x)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        at, x = self.features(text)
        p = _softmax((x @ self.weights[at] + self.bias) / self.heat)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(texts: list[str], langs: list[str]) -> Model:
    found = [counts(t) for t in texts]
    return learn_counts([(at := np.flatnonzero(n), n[at]) for n in found], langs)


def learn_counts(texts: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model:
    """FTRL over EPOCHS passes on four fifths, the temperature on the last fifth; texts: (places, counts)."""
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names)
    y = np.array([names.index(v) for v in langs])
    size, k = 1 << BITS, len(names)
    seen, raw = np.zeros(size), [(at, 1 + np.log(n)) for at, n in texts]
    for at, _ in raw:
        seen[at] += 1
    model = Model(names, np.log((1 + len(texts)) / (1 + seen)) + 1)
    rows = [(at, (x := v * model.idf[at]) / np.sqrt(x @ x)) for at, v in raw]
    z, n2 = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(zi: np.ndarray, root: np.ndarray) -> np.ndarray:
        return (np.clip(zi, -L1, L1) - zi) / ((BETA + root) / STEP + L2)

    aside = np.arange(len(y)) % 5 == 4
    rng, one = np.random.default_rng(3), np.eye(k)
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~aside)):
            at, x = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            zi, ni = z[at], n2[at]
            root = np.sqrt(ni)
            w = weights(zi, root)
            g = x[:, None] * (_softmax(x @ w) - one[y[i]])[None, :]
            ni += g * g
            z[at] = zi + g - (np.sqrt(ni) - root) / STEP * w
            n2[at] = ni
    full = weights(z, np.sqrt(n2))
    model.weights, model.bias = full[:-1], full[-1]
    logits = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in np.flatnonzero(aside)]).reshape(-1, k)
    if len(logits):
        held = y[aside]
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), held] + 1e-300).mean()
        model.heat = float(min(np.geomspace(0.05, 5, 80), key=loss))
    return model


def fit(docs: DataFrame, keep=None) -> Model:
    """A model of at most SAMPLE documents that ``keep`` admits, learned from text and lang alone."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    # ids are chosen first, so that only the chosen texts travel
    ids = least_by_hash(rows.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), F.xxhash64("doc_id"), SAMPLE, "doc_id")
    found = once(rows.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id"), "text", "lang")

    def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole texts as sparse counts: what the driver gets does not grow with a text."""
        for batch in batches:
            texts = [t if _LETTER.search(t) else None for t in batch.column(1).to_pylist()]
            n = [None if t is None else counts(t) for t in texts]
            at = [None if c is None else np.flatnonzero(c) for c in n]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array([None if c is None else c[a] for c, a in zip(n, at, strict=True)], pa.list_(pa.int32()))],
                names=["doc_id", "lang", "at", "n"],
            )

    out = text_batches(found).mapInArrow(brief, "doc_id long, lang string, at array<int>, n array<int>").where("at is not null").toArrow().to_pylist()
    out.sort(key=lambda r: (r["doc_id"] * 2654435761 % 4294967296, r["doc_id"], r["lang"]))
    return learn_counts([(np.array(r["at"], np.int64), np.array(r["n"], np.int64)) for r in out], [r["lang"] for r in out])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "held_out", "lang_pred", "score"])

    return text_batches(docs).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = fit(docs, crc_mod("doc_id", 4) != 2)
    return predict(docs.withColumn("held_out", crc_mod("doc_id", 4) == 2), model)
