import zlib

import numpy as np
import pytest

from conftest import DATA
from glotsieve.llm import queries
from glotsieve.llm import toxicity_ftrl as tf


def test_features():
    of = tf.Features(20)
    assert len(of(None)) == len(of("")) == len(of("!?")) == 0
    assert len(of("a")) == 1 and len(of("a b")) == 3
    assert len(of("a b c")) == 3 + 2 + 1 + 1
    assert set(of("a x b")) - set(of("a x")) - set(of("x b"))  # pair around x, and the triple
    assert (tf.Features(20)("Ä b\nä B") == of("ä b ä b")).all()
    assert len(of("w " * 100000)) == 4


def dense_step(z, n, row, label, alpha, beta, l1, l2):
    """One textbook step, coordinate by coordinate; the last has no pull."""
    w = {}
    for i in row:
        pull = l1 if i < len(z) - 1 else 0
        w[i] = 0.0 if abs(z[i]) <= pull else -(z[i] - np.sign(z[i]) * pull) / ((beta + n[i] ** 0.5) / alpha + l2)
    g = 1 / (1 + np.exp(-sum(w.values()))) - label
    for i in row:
        z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
        n[i] += g * g


def test_train_is_ftrl():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 16, 5)).astype(np.int32) for _ in range(80)]
    y = np.array([int(3 in r) for r in rows])
    at, weight, bias = tf.train(rows, y, bits=4, epochs=2, alpha=0.5, beta=1.0, l1=0.3, l2=0.1)
    z, n = np.zeros(17), np.zeros(17)
    for _ in range(2):
        for r, label in zip(rows, y):
            dense_step(z, n, [*r, 16], label, 0.5, 1.0, 0.3, 0.1)
    w = [0.0 if abs(a) <= 0.3 else -(a - np.sign(a) * 0.3) / ((1 + b**0.5) / 0.5 + 0.1) for a, b in zip(z[:16], n)]
    assert np.allclose([dict(zip(at.tolist(), weight)).get(i, 0.0) for i in range(16)], w)
    assert np.isclose(bias, -z[16] / ((1 + n[16] ** 0.5) / 0.5 + 0.1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_toxicity_ftrl(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    found = [r for r in held if r.toxic]
    assert sum(r.predicted for r in found) / len(found) > 0.6
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_cases(spark):
    """Labels of one class or none, nulls, empty and repeated texts, clashing names."""
    rows = [(i, t, 0.5) for i, t in enumerate([None, "", "bad word", "good word", "bad word", "x " * 50000])] + [(None, "bad", 1.0)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, score double")
    def labels(*given):
        return spark.createDataFrame(list(given), "doc_id long, toxic int, text string")

    for given, score in (((), 0.0), (((2, 0, "a"), (3, None, "a")), 0.0), (((2, 1, "a"), (None, 0, "a")), 1.0)):
        got = tf.score(docs, tf.fit(docs, labels(*given))).collect()
        assert len(got) == 10 and all(abs(r.score - score) < 1e-9 for r in got)
    mixed = labels(*((i, int(i == 2), None) for i in range(1, 6)), (2, 1, None))
    got = tf.score(docs, tf.fit(docs, mixed)).collect()
    assert len({(r.doc_id, r.score) for r in got}) == 7 and all(0 < r.score < 1 for r in got)
    assert tf.score(docs.limit(0), tf.fit(docs.limit(0), mixed)).count() == 0
