"""Toxicity by FTRL-proximal logistic regression over hashed word features.

A text is the set of its words, word pairs, word triples and pairs around one
skipped word, each hashed to one of 2**bits coordinates. FTRL-proximal keeps a
learning rate for every coordinate and pulls weights to zero, so what is left
after training is a short list of coordinates and weights, which is broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotsieve.llm.common import class_counts, labelled_sample

BITS = 20
SAMPLE = 5_000  # labelled rows of each class that training takes, at most
TRAIN_BYTES = 16_384  # texts longer than this are scored, but not learned from
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 1.0
WORD_CACHE = 300_000
_WORD = re.compile(r"\w+")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Features:
    """Coordinates of a text, each once; hashes of words are remembered up to a bound."""

    def __init__(self, bits: int):
        self.down, self.known = np.uint64(64 - bits), {}

    def _hash(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= WORD_CACHE:
                self.known.clear()
            found = self.known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) + 1
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        h = np.fromiter(map(self._hash, words), np.uint64, len(words))
        grams = [h * _A, h[:-1] * _A + h[1:] * _B + np.uint64(1), h[:-2] * _A + h[2:] * _B + np.uint64(2)]
        grams.append(h[:-2] * _A + h[1:-1] * _B + h[2:] * _C + np.uint64(3))
        mixed = np.concatenate(grams)
        mixed ^= mixed >> np.uint64(31)
        mixed *= _C
        mixed ^= mixed >> np.uint64(29)
        mixed *= _A
        return np.unique(mixed >> self.down).astype(np.int32)


def train(
    rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS,
    alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates with weights other than zero, these weights, and the bias.

    Rows come one by one in the order given; the bias is a coordinate without
    the pull to zero.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits
    pull = np.full((1 << bits) + 1, l1)
    pull[bias] = 0

    def weights(at):
        zs = z[at]
        beyond = np.abs(zs) - pull[at]
        return np.where(beyond > 0, -np.sign(zs) * beyond / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for row, label in zip(rows, labels):
            at = np.append(row, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    some = np.flatnonzero(w[:bias])
    return some.astype(np.int32), w[some], float(w[bias])


def _features(bits: int):
    @F.arrow_udf("array<int>")
    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Features(bits)
        for texts in batches:
            yield pa.array([of(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return rows


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
    sample: int = SAMPLE, bits: int = BITS, train_bytes: int = TRAIN_BYTES, **how: float,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learned from at most ``sample`` labelled rows of each class, of up to ``train_bytes`` each.

    Features are made where the texts lie; one task, whose input is bounded by
    the sample, runs the passes over them. What comes back is at most 2**bits
    weights. The bias is moved from the shares of the classes in the sample to
    those of all labels. With fewer than two classes there are no weights, and
    the bias gives the share of class 1 (none without labels).
    """
    zero, one = class_counts(labels, label, key)
    if not zero or not one:
        return np.empty(0, np.int32), np.empty(0), 35.0 if one else -35.0
    chosen = labelled_sample(docs, labels, label, sample, key, text, train_bytes)
    row = _features(bits)("text").alias("row")
    chosen = chosen.select(F.lit(0).alias("all"), F.xxhash64("_key").alias("at"), "label", row)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        y = table["label"].to_numpy()
        rows = [np.asarray(r.values) for r in table["row"].combine_chunks()]
        if y.min() == y.max():  # texts of one class are missing
            return pa.table({"at": [-1], "weight": [np.log(one / zero)]})
        at, weight, bias = train(rows, y, bits, **how)
        bias += np.log(one / zero) - np.log(y.sum() / (len(y) - y.sum()))
        return pa.table({"at": np.append(at, -1).astype(np.int32), "weight": np.append(weight, bias)})

    model = chosen.groupBy("all").applyInArrow(learn, "at int, weight double").toArrow().sort_by("at")
    if not len(model):  # no text of a labelled row is at hand
        return np.empty(0, np.int32), np.empty(0), float(np.log(one / zero))
    at, weight = model["at"].to_numpy(), model["weight"].to_numpy()
    return at[1:], weight[1:], float(weight[0])


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(key, score), one row for each row: the probability of class 1 by the whole text.

    A null or empty text has no words and is scored by the bias. Repeated rows
    get equal scores. Rows stay in their tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, weight, bias = sent.value
        dense = np.zeros(1 << bits)
        dense[at] = weight
        of = Features(bits)
        for texts in batches:
            sums = np.array([dense[of(t.as_py())].sum() for t in texts], float) + bias
            yield pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return docs.select(F.col(key), probability(F.col(text)).alias("score"))
