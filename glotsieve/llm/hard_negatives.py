"""Hard negatives by summaries of vector segments.

A vector is cut into segments, and each keeps its mean and its deviation. For
two segments of m components the inner product lies within

    m * (mean * mean' -+ deviation * deviation')

so sums over segments bound the product of two vectors from both sides. One
segment for the whole vector comes first, then finer cuts for the pairs that
are still open, and only what is left is multiplied out, in whole numbers.

Two searches run that way. The positives of an anchor are its best rows of
the same label: a row is out when its upper bound is below as many lower bounds
as are asked for. The negatives of a positive are the best rows of other
labels within a share of the positive's score: a row is out when it cannot be
in that range, or when enough rows that are surely in it have better lower
bounds.

Rows are dealt into blocks and anchors into blocks; a task has one of each, of
fixed size, and returns what is best there. The best of all blocks are merged
by a window over a few rows a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotsieve.session import settle

SEGMENTS = (1, 4, 16)
POSITIVES = 5
NEGATIVES = 5
SHARE = 80  # per cent of the positive's score that a negative reaches at least
SCALE = 256
BLOCK = 16_384  # rows in a block
ANCHORS = 2048  # anchors in a block
AT_ONCE = 64  # anchors whose bounds are in memory together
PAIRS = 1 << 17  # pairs multiplied together
LEAST_BLOCKS = 12


def summaries(x: np.ndarray, segments: tuple[int, ...] = SEGMENTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each cut, means and deviations of the segments, both times the root of the segment's length."""
    d = x.shape[1]
    out = []
    for n in segments:
        edges = np.linspace(0, d, min(n, d) + 1).astype(int) if d else np.zeros(1, int)
        root = np.sqrt(np.diff(edges))
        parts = [x[:, a:b] for a, b in zip(edges, edges[1:])]
        mean = np.stack([p.mean(axis=1) for p in parts], 1) if parts else np.zeros((len(x), 0))
        deviation = np.stack([p.std(axis=1) for p in parts], 1) if parts else np.zeros((len(x), 0))
        out.append((mean * root, deviation * root))
    return out


class Side:
    """Vectors of one length with their summaries, keys and labels."""

    def __init__(self, table: pa.Table, rows: np.ndarray):
        part = table.take(pa.array(rows))
        self.uid, self.label = part["uid"].to_numpy(), part["label"].to_numpy()
        key = part["key"].combine_chunks()
        self.no_key, self.key = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy()
        self.x = part["vec"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(part), -1)
        self.summaries = summaries(self.x)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))

    def some(self, rows: np.ndarray) -> Side:
        out = Side.__new__(Side)
        for name in ("uid", "label", "no_key", "key", "x", "norm"):
            setattr(out, name, getattr(self, name)[rows])
        out.summaries = [(m[rows], s[rows]) for m, s in self.summaries]
        return out


def bounds(rows: Side, anchors: Side, some: np.ndarray, cut: int, open_: np.ndarray | None):
    """Lower and upper bounds of products, rows by anchors; for the open pairs alone where these are few."""
    (m, s), (am, as_) = rows.summaries[cut], (x[some] for x in anchors.summaries[cut])
    # products of summaries are rounded
    slack = 1e-9 * rows.norm[:, None] * anchors.norm[some] + 1e-6
    if open_ is None or open_.mean() > 0.2:
        middle, reach = m @ am.T, s @ as_.T + slack
        return middle - reach, middle + reach
    i, j = np.nonzero(open_)
    low, high = np.full(open_.shape, -np.inf), np.full(open_.shape, -np.inf)
    middle, reach = np.einsum("nd,nd->n", m[i], am[j]), np.einsum("nd,nd->n", s[i], as_[j]) + slack[i, j]
    low[i, j], high[i, j] = middle - reach, middle + reach
    return low, high


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, as whole numbers."""
    biggest = (np.abs(x).max(initial=0)) * (np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if biggest < 1 << 53:
        return np.einsum("nd,nd->n", x, y).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(x.tolist(), y.tolist())]
    return np.array(exact, object)


def _scores(rows: Side, anchors: Side, some: np.ndarray, open_: np.ndarray):
    """(row, anchor, score) of open pairs; a product beyond 64 bits is no score."""
    i, j = np.nonzero(open_)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], some[j[at : at + PAIRS]]
        score = products(rows.x[a], anchors.x[b])
        if score.dtype == object:
            fits = np.array([-(1 << 63) <= s < 1 << 63 for s in score], bool)
            a, b, score = a[fits], b[fits], score[fits].astype(np.int64)
        yield a, b, score


def _best(rows: Side, i: np.ndarray, group: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Positions of the best of each group: by score, then key, those without a key last."""
    order = np.lexsort((rows.uid[i], rows.key[i], rows.no_key[i], -score.astype(np.float64), group))
    # scores above 2**53 may tie as floats: whole numbers decide
    if len(score) and np.abs(score).max() >= 1 << 53:
        order = np.array(sorted(range(len(i)), key=lambda k: (group[k], -int(score[k]), rows.no_key[i[k]], rows.key[i[k]], rows.uid[i[k]])), np.int64)
    ordered = group[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < most]


def _threshold(low: np.ndarray, most: int) -> np.ndarray:
    """The ``most``-th largest lower bound of every anchor."""
    if len(low) < most:
        return np.full(low.shape[1], -np.inf)
    return np.partition(low, len(low) - most, axis=0)[len(low) - most]


def positives(rows: Side, anchors: Side, most: int):
    """(row, anchor, score): candidates for the best rows of the anchor's label, other than itself."""
    for label in np.unique(anchors.label):
        mine, theirs = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        if not len(theirs):
            continue
        part = rows.some(theirs)
        for at in range(0, len(mine), AT_ONCE):
            some = mine[at : at + AT_ONCE]
            open_ = part.uid[:, None] != anchors.uid[some]
            for cut in range(len(SEGMENTS)):
                low, high = bounds(part, anchors, some, cut, None if cut == 0 else open_)
                low[~open_] = -np.inf
                open_ &= high >= _threshold(low, most)
            for i, j, score in _scores(part, anchors, some, open_):
                best = _best(part, i, j, score, most)
                yield theirs[i[best]], j[best], score[best]


def negatives(rows: Side, anchors: Side, scores: list[list[int]], most: int, share: int):
    """(row, anchor, positive's score, score): candidates of other labels within a share of each positive's score."""
    for at in range(0, len(anchors.uid), AT_ONCE):
        some = np.arange(at, min(at + AT_ONCE, len(anchors.uid)))
        width = max(len(scores[a]) for a in some)
        # a score too many is one that nothing reaches
        wanted = np.full((width, len(some)), -1, object)
        for k, a in enumerate(some):
            wanted[: len(scores[a]), k] = scores[a]
        top = wanted.astype(np.float64)
        bottom = np.array([[-(-share * p // 100) for p in line] for line in wanted], object).astype(np.float64)
        other = rows.label[:, None] != anchors.label[some]
        open_ = [other & (top[k] >= 0) for k in range(width)]
        slack = 1e-6 + 1e-12 * np.abs(top)
        whole = None
        for cut in range(len(SEGMENTS)):
            low, high = bounds(rows, anchors, some, cut, whole)
            for k in range(width):
                o = open_[k]
                o &= (high >= bottom[k] - slack[k]) & (low <= top[k] + slack[k])
                sure = np.where(o & (high <= top[k] - slack[k]) & (low >= bottom[k] + slack[k]), low, -np.inf)
                o &= high >= _threshold(sure, most)
            whole = np.logical_or.reduce(open_)
        for i, j, score in _scores(rows, anchors, some, whole):
            for k in range(width):
                p = wanted[k][j - at]
                within = (p >= 0) & (100 * score.astype(object) >= share * p) & (score <= p)
                a, b, s, p = i[within.astype(bool)], j[within.astype(bool)], score[within.astype(bool)], p[within.astype(bool)]
                best = _best(rows, a, b, s, most)
                yield a[best], b[best], p[best].astype(np.int64), s[best]


def _sides(rows: pa.Table, anchors: pa.Table):
    """Rows and anchors by length of vectors."""
    sizes = [t["vec"].combine_chunks().value_lengths().to_numpy() for t in (rows, anchors)]
    for size in np.intersect1d(*sizes):
        at = [np.flatnonzero(s == size) for s in sizes]
        yield Side(rows, at[0]), Side(anchors, at[1]), at[1]


_FOUND = {"anchor": pa.int64(), "positive": pa.int64(), "uid": pa.int64(), "key": pa.int64(), "score": pa.int64()}


def _table(found: list[tuple]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 6
    no_key = columns.pop().astype(bool)
    out = {n: pa.array(c.astype(np.int64), k, mask=no_key if n == "key" else None) for (n, k), c in zip(_FOUND.items(), columns)}
    return pa.table(out)


def _positives(most: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(anchors):
            for a, b, _ in _sides(rows, anchors):
                for i, j, score in positives(a, b, most):
                    found.append((b.uid[j], np.zeros(len(i), np.int64), a.uid[i], a.key[i], score, a.no_key[i]))
        return _table(found)

    return run


def _negatives(most: int, share: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(anchors):
            wanted = anchors["scores"].to_pylist()
            for a, b, at in _sides(rows, anchors):
                for i, j, p, score in negatives(a, b, [wanted[x] for x in at], most, share):
                    found.append((b.uid[j], p, a.uid[i], a.key[i], score, a.no_key[i]))
        return _table(found)

    return run


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: int = SCALE,
    most_positives: int = POSITIVES,
    most_negatives: int = NEGATIVES,
    share: int = SHARE,
    block: int = BLOCK,
    anchor_block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each component x counts as floor(scale * x), and a score is the inner
    product of two vectors of equal length, in whole numbers; higher ones come
    first, ties by smaller key, rows without a key last. For each row where
    ``anchors`` holds, positives are its first ``most_positives`` other rows of
    the same label. For each of them, with score p, the first
    ``most_negatives`` rows of another label with a score from ``share`` per
    cent of p up to p are returned, ranked from 1; below 0 there are none.
    Rows take no part if label or vector is null, or a component is null or
    not finite; products beyond 64 bits are no scores. Rows that repeat are
    rows of their own. An empty table, or one without anchors, has no result.
    """
    label = F.col(label) if isinstance(label, str) else label
    given = vectors.select(
        F.col(key).cast("bigint").alias("key"), label.cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < 1e18))
    given = given.filter(F.col("label").isNotNull() & F.col("vec").isNotNull()).filter(finite)
    given = given.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale)))
    rows = settle(given.withColumn("uid", F.monotonically_increasing_id()), "whole-vectors")
    n, n_anchors, widest = rows.agg(
        F.count("*"), F.count_if("anchor"), F.max(F.aggregate("vec", F.lit(0).cast("bigint"), lambda m, x: F.greatest(m, F.abs(x))))
    ).first()
    # numbers travel in two bytes where all fit
    kind = "smallint" if (widest or 0) < 1 << 15 else "bigint"
    rows = rows.withColumn("vec", F.col("vec").cast(f"array<{kind}>"))
    blocks = max(math.ceil(n / block), min(LEAST_BLOCKS, math.ceil(n / 256)), 1)
    groups = max(math.ceil(n_anchors / anchor_block), 1)
    deal = lambda count, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    dealt = rows.drop("anchor").withColumn("part", deal(blocks, 0)).withColumn("of", every(groups)).groupBy("part", "of")

    def searched(asked: DataFrame, run) -> DataFrame:
        asked = asked.withColumn("of", deal(groups, 1)).withColumn("part", every(blocks))
        schema = ", ".join(f"{c} bigint" for c in _FOUND)
        return dealt.cogroup(asked.groupBy("part", "of")).applyInArrow(run, schema)

    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("uid")]
    # read anew: both sides of a cogroup need columns of their own
    asked = settle(rows.filter("anchor").select("uid", "key", "label", "vec"), "anchors")
    best = Window.partitionBy("anchor").orderBy(*order)
    found = searched(asked, _positives(most_positives)).withColumn("place", F.row_number().over(best))
    found = settle(found.filter(F.col("place") <= most_positives).select("anchor", "uid", "key", "score"), "positives")
    scores = found.groupBy("anchor").agg(F.collect_set("score").alias("scores")).withColumnRenamed("anchor", "uid")
    near = searched(asked.join(scores, "uid"), _negatives(most_negatives, share))
    best = Window.partitionBy("anchor", "positive").orderBy(*order)
    near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most_negatives)
    pairs = found.select(
        "anchor", F.col("uid").alias("_of"), F.col("key").alias("positive_id"), F.col("score").alias("positive")
    )
    names = asked.select(F.col("uid").alias("anchor"), F.col("key").alias("anchor_id"))
    out = near.select("anchor", "positive", "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(pairs, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("positive").alias("positive_score"), "negative_score"
    )
