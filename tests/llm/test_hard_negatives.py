import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from glotsieve.llm import hard_negatives as hn
from glotsieve.llm import queries
from parity import connect, differences


@pytest.mark.parametrize("dims", [1, 3, 64, 100])
def test_bounds_hold(dims):
    rng = np.random.default_rng(dims)
    x, y = rng.integers(-300, 300, (80, dims)).astype(float), rng.integers(-300, 300, (70, dims)).astype(float)
    x[3] = 0
    true, before = x @ y.T, None
    for (m, s), (am, as_) in zip(hn.summaries(x), hn.summaries(y)):
        middle, reach = m @ am.T, s @ as_.T + 1e-6
        assert (middle - reach <= true).all() and (true <= middle + reach).all()
        # a finer cut bounds no worse in sum
        assert before is None or reach.sum() <= before + 1e-6
        before = reach.sum()


def brute(rows, anchor, positives=5, negatives=5, share=80, scale=256):
    ok = [
        (k, [math.floor(scale * x) for x in v], l, i) for i, (k, v, l) in enumerate(rows)
        if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    last = lambda k: (k is None, k or 0)
    out = []
    for k, v, l, i in ok:
        if not anchor(k):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), last(j), j, m) for j, w, m, n in ok if len(w) == len(v) and n != i), key=lambda s: s[:2])
        for p, _, pid, m in [s for s in scored if s[3] == l][:positives]:
            p = -p
            near = [(-s, j) for s, _, j, m in scored if m != l and share * p <= -100 * s <= 100 * p]
            out += [(k, pid, r + 1, j, p, s) for r, (s, j) in enumerate(near[:negatives])]
    return sorted(out, key=str)


def vectors(seed, n, dims=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.2) for x in c]
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2])))
    rows += [(1000 + i, v, l) for i, (_, v, l) in enumerate(rows[:20])]  # ties
    rows += [(2000, None, 1), (2001, [1.0] * dims, None), (2002, [float("nan")] * dims, 0), (2003, [None] + [1.0] * (dims - 1), 0),
             (2004, [float("inf")] * dims, 0), (2005, [0.0] * dims, 1), (2010, [0.5] * 3, 1), (2011, [0.5] * 3, 1), (2012, [0.5, 0.45, 0.5], 2),
             (2020, [], 1), (2021, [], 1), (2022, [], 0), (None, rows[0][1], 0), (None, rows[3][1], 2)]
    return rows


def result(df, **options):
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()), key=str)


@pytest.mark.parametrize("block, anchor_block, at_once", [(16_384, 2048, 64), (40, 7, 64), (3, 2, 1)])
def test_against_brute_force(spark, block, anchor_block, at_once):
    rows = vectors(block, 120)
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, embedding array<double>, label int, uid int, key string")
    anchor = lambda k: k is not None and k % 10 == 0
    expected = brute(rows, anchor)
    assert len(expected) > 100
    assert result(df.repartition(3), block=block, anchor_block=anchor_block) == expected


def test_other_limits_and_large_numbers(spark):
    rows = vectors(1, 40) + [(4000 + 10 * i, [1e9 + i] * 8, i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    anchor = lambda k: k is not None and k % 10 == 0
    fits = [r for r in brute(rows, anchor, 2, 3, 50) if abs(r[4]) < 1 << 63]
    assert result(df, most_positives=2, most_negatives=3, share=50) == fits


def test_empty(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert result(spark.createDataFrame([], kinds)) == []
    assert result(spark.createDataFrame([(1, [1.0], 0), (3, [1.0], 1)], kinds)) == []


def test_query(spark):
    name = "op12_hard_negatives"
    assert differences(queries.QUERIES[name](spark, DATA), connect(DATA), queries.SQL[name]) is None
