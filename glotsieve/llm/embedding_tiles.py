"""Near-duplicate embeddings by products of int8 tiles.

Vectors are normalised and quantised to int8, each with a scale of its own,
and its quantisation error is measured. With u = q + e (q the quantised
vector, e its error) the true cosine of two vectors is within

    |e_u| + (1 + |e_u|) * |e_v|

of the product of the quantised ones. The bound holds for every pair, so a
pair whose product lies further below the threshold is no link, one as far
above it is one, and only those between are computed in double precision.

Rows are dealt into blocks, and every pair of blocks meets in one group, whose
size is fixed: a task never gets more as the table grows. What meets there are
the int8 values, scales and errors, settled once. A group returns, for each
vector with links there, their number and one edge to the group's own
component, so many copies of one vector do not become pairs; and it marks the
vectors of pairs that the bound leaves open. Only these are fetched in double
precision, for that pair of blocks, and only their open pairs are computed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotsieve.llm.common import components
from glotsieve.session import settle

THRESHOLD = 0.95
BLOCK = 16_384
TILE = 1024
SLACK = 1e-6  # of single-precision scaling


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in double precision, int8 values, scales and error norms."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    values = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - values * scale[:, None]) ** 2).sum(axis=1))
    return unit, values, scale, error


def bounded(left, right, threshold: float, tile: int = TILE, same: bool = False):
    """Yields (i, j, sure): pairs of two quantised sides that may reach the threshold, and whether they do for certain.

    A side is (int8 values, scales, errors). ``same``: both sides are one, and i < j is asked for.
    """
    q_l, s_l, e_l = left
    q_r, s_r, e_r = right
    # products of int8 are whole numbers; they are exact in the float type as long as sums fit
    kind = np.float32 if q_l.shape[1] * 127 * 127 < 1 << 24 else np.float64
    for a in range(0, len(q_l), tile):
        qa = q_l[a : a + tile].astype(kind)
        for b in range(a if same else 0, len(q_r), tile):
            qb = q_r[b : b + tile].astype(kind)
            about = (qa @ qb.T) * s_l[a : a + tile, None].astype(kind) * s_r[None, b : b + tile].astype(kind)
            ea, eb = e_l[a : a + tile], e_r[b : b + tile]
            widest = ea.max() + (1 + ea.max()) * eb.max() + SLACK
            i, j = np.nonzero(about >= threshold - widest)
            if same and a == b:
                i, j = i[i < j], j[i < j]
            bound = ea[i] + (1 + ea[i]) * eb[j] + SLACK
            value = about[i, j].astype(np.float64)
            some = value + bound >= threshold
            if some.any():
                yield a + i[some], b + j[some], (value - bound >= threshold)[some]


def reach(unit_l: np.ndarray, unit_r: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of unit vectors reach the threshold in double precision."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        at = slice(k, k + (1 << 16))
        out[at] = np.einsum("nd,nd->n", unit_l[i[at]], unit_r[j[at]]) >= threshold
    return out


def join_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (smallest index of a component) after linking u[k] with v[k]."""
    while True:
        a, b = labels[u], labels[v]
        if (a == b).all():
            return labels
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            deeper = labels[labels]
            if (deeper == labels).all():
                break
            labels = deeper


TILES = "uid bigint, d int, q binary, scale double, error double"
FOUND = "a int, b int, uid bigint, first boolean, n bigint, root bigint, open boolean"


def _units(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.float64)


def tiles(vectors: DataFrame) -> DataFrame:
    """(uid, d, q, scale, error) of usable ``vectors(uid, vec)``: what products need, a byte for each component."""

    def work(batches):
        for batch in batches:
            sizes = pa.compute.list_value_length(batch["vec"])
            for d in pa.compute.unique(sizes).to_pylist():
                part = batch.filter(pa.compute.equal(sizes, d))
                _, q, scale, error = quantise(_units(part["vec"]))
                values = pa.array([row.tobytes() for row in q], pa.binary())
                yield pa.record_batch(
                    [part["uid"], pa.array([d] * len(part), pa.int32()), values, pa.array(scale), pa.array(error)],
                    names=["uid", "d", "q", "scale", "error"],
                )

    return vectors.mapInArrow(work, TILES)


def _compare(threshold: float, late: bool):
    """Links of a pair of blocks: the certain ones, or ``late`` those of open pairs, in double precision."""

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        uid, first = rows["uid"].to_numpy(), rows["first"].to_numpy()
        q = np.frombuffer(b"".join(rows["q"].to_pylist()), np.int8).reshape(len(rows), -1)
        side = q, rows["scale"].to_numpy(), rows["error"].to_numpy()
        at_l, at_r = np.flatnonzero(first), np.flatnonzero(~first) if a != b else np.flatnonzero(first)
        count, labels = np.zeros(len(rows), np.int64), np.arange(len(rows))
        open_ = np.zeros(len(rows), bool)
        if late:
            unit = quantise(_units(rows["vec"].combine_chunks()))[0]
        parts = [[x[at] for x in side] for at in (at_l, at_r)]
        for i, j, sure in bounded(*parts, threshold, same=a == b):
            i, j = at_l[i], at_r[j]
            if late:
                i, j = i[~sure], j[~sure]
                linked = reach(unit, unit, i, j, threshold)
            else:
                linked = sure
                open_[i[~sure]] = open_[j[~sure]] = True
            i, j = i[linked], j[linked]
            count += np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
            labels = join_labels(labels, i, j)
        some = np.flatnonzero((count > 0) | open_)
        blocks = [pa.array(np.full(len(some), x, np.int32)) for x in (a, b)]
        return pa.table(
            [*blocks, uid[some], first[some], count[some], uid[labels[some]], open_[some]],
            names=["a", "b", "uid", "first", "n", "root", "open"],
        )

    return compare


def _block_links(vectors: DataFrame, tile: DataFrame, d: int, blocks: int, threshold: float) -> DataFrame:
    """Number of links and an edge for each vector with links in a pair of blocks of vectors of ``d`` components."""
    own = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = tile.filter(F.col("d") == d).select("uid", "q", "scale", "error", own.alias("own"), other.alias("other"))
    dealt = dealt.select(
        "uid", "q", "scale", "error",
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("first"),
    )
    certain = settle(dealt.groupBy("a", "b").applyInArrow(_compare(threshold, False), FOUND), "certain-links")
    left_open = certain.filter("open").select("a", "b", "uid", "first")
    fetched = left_open.join(vectors.select("uid", "vec"), "uid").join(tile.select("uid", "q", "scale", "error"), "uid")
    late = fetched.groupBy("a", "b").applyInArrow(_compare(threshold, True), FOUND)
    return certain.union(late).filter("n > 0").select("uid", "n", "root")


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each row of ``vectors``.

    Two rows link if the cosine of their vectors, in double precision, is at
    least ``threshold``, which is above 0. A vector that is null, empty or
    zero, or holds null or non-finite components, links with nothing, and
    vectors of different lengths do not link. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest key reachable, the own
    one included; rows of null keys take part, and one without any key in reach
    has a null component. Repeated rows link with each other. Work is that of
    all pairs; what one task holds is not.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    # identifiers of rows are settled with them: a task that runs again must not number anew
    rows = settle(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.filter("vec is not null").filter(finite & F.exists("vec", lambda x: x != 0))
    sizes = usable.groupBy(F.size("vec").alias("d")).count().collect()  # a row for each length in use
    compared = []
    tile = settle(tiles(usable.select("uid", "vec")), "tiles")
    for d, n in sizes:
        blocks = max(math.ceil(n / block), min(8, math.ceil(n / TILE)))
        compared.append(_block_links(usable, tile, d, blocks, threshold))
    if not compared:
        none = F.lit(0).cast("bigint")
        out = rows.select("key", none.alias("n_links"), F.col("key").alias("component_id"))
    else:
        found = compared[0]
        for more in compared[1:]:
            found = found.union(more)
        found = settle(found, "tile-links")
        member = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
        counts = found.groupBy("uid").agg(F.sum("n").alias("n_links"))
        linked = rows.select("uid", "key").join(member, F.col("uid") == F.col("node"))
        least = linked.groupBy("component").agg(F.min("key").alias("component_id"))
        linked = member.join(least, "component").select(F.col("node").alias("uid"), "component_id")
        out = rows.select("uid", "key").join(counts, "uid", "left").join(linked, "uid", "left")
        out = out.select(
            "key",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        )
    return out.select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )
