"""Operator 1, quality classifier: Naive Bayes support vectors.

Binary n-gram indicators are scaled by the log-count ratio of the two classes and
a linear hinge-loss model is fitted to them by dual coordinate descent. Indicators
are hashed into 2**BITS places and come from two streams over the whole text:
words, and word shapes (case, marks, repetition of the word before). Fitting uses
at most LABELLED labelled documents (the smallest by a hash of the id); scoring
covers whole texts of all documents. Margins become probabilities by a logistic
fit on out-of-fold margins.

Defined results: null and empty texts have no indicators and get the score of the
model's intercept; repeated rows get equal scores; if labels are missing or of one
class, the score is the share of label 1 (0.5 without labels) for every row; very
long texts are read whole; ties between ids of equal hash go to the smaller id; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import crc_mod, labelled_ids, once, table, text_batches

#: Bound of the labelled sample that is fitted.
LABELLED = 8_000
BITS, ALPHA, COST, EPOCHS, FOLDS = 18, 1.0, 0.1, 12, 4
THRESHOLD = 0.3
#: Words that a worker remembers.
CACHE = 300_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Letters and digits by their kind: A, a or 0.
_KIND = {k: "A" for k in (*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF))} | {k: "a" for k in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))} | {k: "0" for k in range(48, 58)}
_ONE, _TWO = re.compile(r"([Aa0])\1+"), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one A, a or 0 each; other runs as two of their mark."""
    return _TWO.sub(r"\1\1", _ONE.sub(r"\1", word.translate(_KIND)))


class Indicators:
    """Places of the n-gram indicators of a text, each once."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = np.uint64((1 << bits) - 1), {}
        self.hashes = np.empty((1024, 2), np.uint64)  # of known words, by their numbers

    def _look(self, word: bytes) -> tuple[int, int]:
        text = word.decode("utf-8", "replace")
        return xxh3_64_intdigest(text.lower()), xxh3_64_intdigest("\x00" + shape(text))

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").encode("utf-8", "replace"))
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = list(set(words).difference(known))
        first = len(known)
        if first + len(new) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes[:first], np.empty((first + 2 * len(new), 2), np.uint64)])
        if new:
            self.hashes[first : first + len(new)] = np.array([self._look(w) for w in new], np.uint64)
            known.update(zip(new, range(first, first + len(new)), strict=True))
        w, s = self.hashes[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].T
        m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        same = np.flatnonzero(w[1:] == w[:-1]) + 1
        s = s.copy()
        s[same] ^= np.uint64(0xA5A5A5A5)  # a shape of its own for a word that repeats the one before
        grams = [w, s, w[:-1] * m1 + w[1:], s[:-1] * m2 + s[1:], s[:-2] * m1 + s[1:-1] * m2 + s[2:]]
        # how often shapes occur is told by the doublings of their share, as indicators of their own
        kinds, counts = np.unique(s, return_counts=True)
        grams.append(kinds * m1 + np.floor(np.log2(counts / len(words))).astype(np.int64).astype(np.uint64) * m2)
        h = np.concatenate(grams)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((h >> np.uint64(20)) & self.mask).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # ratio times weight by place, float32
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def score(self, at: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        margin = float(self.weights[at].sum(dtype=np.float64)) / max(1.0, np.sqrt(len(at))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def _ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    p, q = np.full(size, ALPHA), np.full(size, ALPHA)
    for at, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[at] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def _descend(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; classes weigh alike in sum."""
    w, bias = np.zeros_like(ratio), 0.0
    xs = [ratio[at] / max(1.0, np.sqrt(len(at))) for at in rows]
    norms = np.array([x @ x + 1.0 for x in xs])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(7)
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    top = np.array([COST * share[int(s)] for s in y])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i], xs[i]
            grad = y[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - grad / norms[i], 0.0), top[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * x
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w * ratio, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton steps with smoothed targets."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    x, b = np.c_[margin, np.ones(len(margin))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def learn(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    y = np.where(labels > 0, 1, -1)
    if not len(y) or abs(y.sum()) == len(y):
        return Model(np.zeros(1 << bits, np.float32), 0, 1, 0, 0.5 if not len(y) else float((y > 0).mean()))
    margins, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
    pick = lambda mask: [rows[i] for i in np.flatnonzero(mask)]
    for k in range(FOLDS):
        inside = fold != k
        w, b = _descend(pick(inside), _ratios(pick(inside), y[inside], 1 << bits), y[inside])
        margins[~inside] = [w[at].sum() / max(1.0, np.sqrt(len(at))) + b for at in pick(~inside)]
    w, b = _descend(rows, _ratios(rows, y, 1 << bits), y)
    return Model(w.astype(np.float32), b, *_logistic(margins, y))


def indicators(docs: DataFrame) -> DataFrame:
    """doc_id, label and the indicator places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Indicators()
        for batch in batches:
            at = [find(t).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "label", "at"])

    return text_batches(docs).select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, at array<int>")


def fit(docs: DataFrame, labels: DataFrame, keep=None) -> Model:
    """A model of at most LABELLED labelled documents that ``keep`` admits."""
    ids = labelled_ids(labels, "quality", LABELLED, keep)
    rows = indicators(once(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "label", "text")).toArrow()
    order = np.argsort(rows["doc_id"].to_numpy() * 2654435761 % 4294967296, kind="stable")
    at, label = rows["at"].combine_chunks(), rows["label"].to_numpy()[order]
    flat, ends = at.flatten().to_numpy().astype(np.int64), at.offsets.to_numpy()
    return learn([flat[ends[i] : ends[i + 1]] for i in order], label)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id and held_out with the score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Indicators()
        for batch in batches:
            found = pa.array([model.score(find(t)) for t in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "held_out", "score"])

    return text_batches(docs).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    out = score(docs.withColumn("held_out", crc_mod("doc_id", 5) == 0), model)
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
