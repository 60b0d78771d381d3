"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

The n-grams are of the words themselves and of their shapes (case, symbols, digits, length, whether a word repeats one
just before), all hashed into one weight vector. A document is scored by one sparse dot product of its n-gram
frequencies with the weights. Only the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fold, labelled_sample
from .textops import BLOCK_BYTES, VISIBLE, Words, blocks, mix, pieces, release, text_of, thrifty

#: The model is fitted on at most so many labelled documents of each class and so many bytes of their texts.
PER_CLASS = 3000
SAMPLE_BYTES = 24 << 20
DIMENSIONS = 1 << 18
SCALE = 8.0
#: Words before an n-gram's last that its features depend on: two more of the n-gram, and the two before its first.
REACH = 4

_KIND = np.zeros(256, np.uint8)  # 0 symbol, 1 upper, 2 lower or non-ASCII, 3 digit
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3


def ngrams(data: np.ndarray, offsets: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram of a block, and the words of each row. The first ``skip`` words of a block of one row only
    stand before those whose n-grams are asked for."""
    words = Words(data, offsets, VISIBLE)
    s, e = words.starts, words.ends
    kind = _KIND[data]
    ends = np.stack([s, e], 1).ravel()
    ends = ends[:-1] if len(ends) and ends[-1] == len(data) else ends

    def count(k):
        return np.add.reduceat(kind == k, ends, dtype=np.int64)[::2] if len(ends) else np.zeros(0, np.int64)

    symbols, upper, lower, digits = (count(k) for k in range(4))
    n = e - s
    title = (kind[s] == 1) & (upper == 1) & (lower > 0)
    case = np.select([upper + lower == 0, upper == 0, title, lower == 0], [0, 1, 2, 3], 4)
    size = np.searchsorted([2, 4, 8, 16, 32], n, "right")
    low = words.hashes()

    def same(k):  # whether the word k before is the same, in the same row
        out = np.zeros(len(low), np.int64)
        out[k:] = (low[k:] == low[:-k]) & (words.doc[k:] == words.doc[:-k])
        return out

    shape = ((((case * 4 + np.minimum(symbols, 3)) * 3 + (digits > 0) + ((digits == n) & (n > 0))) * 6 + size) * 2 + same(1)) * 2 + same(2)
    shape = mix(shape.astype(np.uint64) + np.uint64(1))
    rows, features = [], []
    for salt, unit, order in ((1, low, 1), (2, low, 2), (3, shape, 1), (4, shape, 2), (5, shape, 3)):
        if len(unit) < order:
            continue
        h = np.full(len(unit) - order + 1, salt, np.uint64)
        for k in range(order):
            h = mix(h ^ unit[k : len(unit) - order + 1 + k])
        inside = words.doc[: len(h)] == words.doc[order - 1 :]
        inside[: max(0, skip - order + 1)] = False
        rows.append(words.doc[: len(h)][inside])
        features.append((h[inside] % np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1)  # 0 is the bias
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words.count - skip
    return np.concatenate(rows), np.concatenate(features), words.count - skip


class FtrlProximal:
    """Follow-the-regularised-leader with a learning rate of its own for each weight, and L1 and L2 penalties."""

    def __init__(self, dimensions: int = DIMENSIONS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dimensions), np.zeros(dimensions)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        """One example: its distinct features and their values."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(sample: list[tuple[str, int]], epochs: int = 4) -> np.ndarray:
    """Weights learned from (text, label) in the given order."""
    model = FtrlProximal()
    examples = []
    for text, label in sample:
        _, f, count = ngrams(*text_of(pa.array([text])))
        at, times = np.unique(f, return_counts=True)
        examples.append((np.concatenate([[0], at]), np.concatenate([[1.0], times * (SCALE / max(count[0], 1))]), float(label)))
    for _ in range(epochs):
        for example in examples:
            model.update(*example)
    return model.weights().astype(np.float32)


def _totals(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the n-grams' weights and the words of each row."""
    row, feature, count = ngrams(data, offsets, skip)
    return np.bincount(row, weights[feature].astype(np.float64), len(offsets) - 1), count


def _long_totals(weights: np.ndarray, data: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of one long text, piece by piece, each with the last words of those before it."""
    total, count, begin, skip = np.zeros(1), np.zeros(1, np.int64), 0, 0
    for _, end in pieces(data, VISIBLE, piece):
        part = data[begin:end]
        offsets = np.array([0, len(part)])
        more, n = _totals(weights, part, offsets, skip)
        total, count = total + more, count + n
        starts = Words(part, offsets, VISIBLE).starts[-REACH:]
        skip = len(starts)
        begin = begin + int(starts[0]) if skip else end
    return total, count


def scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, piece: int = BLOCK_BYTES) -> np.ndarray:
    """Probabilities of label 1 for the rows of a block; a row without words has the bias alone. One long row is taken in pieces."""
    total, count = _long_totals(weights, data, piece) if len(offsets) == 2 and len(data) > piece else _totals(weights, data, offsets)
    return 1 / (1 + np.exp(-np.clip(weights[0] + total * (SCALE / np.maximum(count, 1)), -35, 35)))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 where score >= threshold).

    Labels are learned only where crc32(doc_id as text) modulo ``folds`` is not ``held``. Null and empty texts are scored
    by the bias; a long text is scored piece by piece, whole; a null doc_id is never held out; without labels every score is one half; an empty table gives an empty
    one. Rows of one id each give a row. Extra columns are ignored.
    """
    sample = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), folds) != held, per_class, SAMPLE_BYTES)
    sent = docs.sparkSession.sparkContext.broadcast(fit(sample))  # DIMENSIONS floats, whatever the input
    del sample
    release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            p = scores(sent.value, *text_of(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(thrifty(run), "doc_id bigint, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
