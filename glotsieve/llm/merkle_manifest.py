"""A Merkle manifest of a dataset, and proofs for many rows at once.

Rows are leaves. The leaves of a group, by key, are the bottom of its tree;
every two nodes in turn become one, a last one alone becomes one too, up to a
single node. The tops of all groups are the leaves of one more tree, whose top
is the root. A digest is SHA-256; what it is made of is joined as text, other
digests in hexadecimal.

Building goes up ``RISE`` levels at a time: a task has an aligned run of nodes
and hashes all that lies above it. Rows are ranked by ranges, never by a
window over a group.

Proofs are made for a partition of leaves at a time, as an octopus: going up
from all its leaves at once, a node that the partition can derive is not
asked for, so what is missing is the least set of nodes; these are fetched
once, by one join for all partitions. The partition then hashes the nodes
that its leaves share, and hands every leaf its own proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from glotsieve.session import settle

RISE = 12  # levels hashed in one task, from up to 2**12 nodes
PART = 4096  # leaves for which proofs are made together
BROADCAST = 300_000  # rows of a table of ranges or groups; more are joined by a shuffle
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # number of the tree above all groups
_PROOF = [
    pa.field("steps", pa.string()), pa.field("siblings", pa.list_(pa.binary())), pa.field("subroot", pa.binary()), pa.field("root", pa.binary()),
]
NODES = "tree bigint, level int, place bigint, hash binary"


def digest(columns: list[Column]) -> Column:
    """Leaf of a row: SHA-256 of its values, each as byte count, a colon and text, or ``-`` if null."""
    parts = []
    for c in columns:
        value = c.cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def join_nodes(nodes: list[bytes]) -> bytes:
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def height(leaves: int) -> int:
    return max(0, leaves - 1).bit_length()


def size_at(leaves: int, level: int) -> int:
    return -(-leaves >> level) if level else leaves


def rise(nodes: list[bytes], leaves: int, level: int, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(level, nodes) above an aligned run of nodes of a tree, up to its top or ``most`` levels."""
    for up in range(level + 1, min(level + most, height(leaves)) + 1):
        nodes = [join_nodes(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        yield up, nodes


def missing(places: np.ndarray, leaves: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the nodes that proofs for all given leaves need and that they cannot derive."""
    known = np.unique(places)
    for level in range(height(leaves)):
        beside = np.setdiff1d(known ^ 1, known, assume_unique=True)
        beside = beside[beside < size_at(leaves, level)]
        if len(beside):
            yield level, beside
        known = np.unique(known >> 1)


def climb(level0: dict[int, bytes], fetched: dict[tuple[int, int], bytes], leaves: int) -> list[dict[int, bytes]]:
    """Nodes by level and place: those at hand or fetched, and those derived from them."""
    levels, known = [], dict(level0)
    for level in range(height(leaves)):
        up = {}
        nodes = known | {place: h for (at, place), h in fetched.items() if at == level}
        levels.append(nodes)
        for place in known:
            if place >> 1 not in up:
                pair = [nodes[p] for p in (place & ~1, place | 1) if p < size_at(leaves, level)]
                up[place >> 1] = join_nodes(pair)
        known = up
    levels.append(known)
    return levels


def path(place: int, leaves: int) -> str:
    """By level from a leaf to the top: L or R, the side of the sibling, or N where there is none."""
    steps = []
    for level in range(height(leaves)):
        steps.append("L" if place & 1 else "R" if place + 1 < size_at(leaves, level) else "N")
        place >>= 1
    return "".join(steps)


def fold(leaf: bytes, steps: str, siblings: list[bytes]) -> bytes:
    """The root that a leaf and its proof lead to."""
    others = iter(siblings)
    for step in steps:
        pair = [leaf] if step == "N" else [next(others), leaf] if step == "L" else [leaf, next(others)]
        leaf = join_nodes(pair)
    return leaf


def folded(leaf, steps, siblings) -> Column:
    @F.arrow_udf("binary")
    def run(leaves: pa.Array, all_steps: pa.Array, proofs: pa.Array) -> pa.Array:
        return pa.array(map(fold, leaves.to_pylist(), all_steps.to_pylist(), proofs.to_pylist()), pa.binary())

    return run(leaf, steps, siblings)


@dataclass
class Manifest:
    """``leaves(key, carried columns, leaf, tree, place, leaves)`` and ``nodes(tree, level, place, hash)``; ``trees`` groups."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int


def _listed(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Settled rows with ``place`` in their group, by ``order``, and ``leaves``, the size of the group.

    Rows are dealt by ranges of group and order, so that a hot group is in
    many tasks; there is a count for each group in each range.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [group, *order]
    ranged = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    ranged = settle(ranged.withColumn("_id", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("_task", F.shiftrightunsigned("_id", 33))
    counts = ranged.groupBy(F.col(group).alias("_group"), "_task").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_group")
    so_far = F.sum("_n").over(whole.orderBy("_task")) - F.col("_n")
    starts = counts.select("_group", F.col("_task").alias("_of"), "_first", so_far.alias("_start"), F.sum("_n").over(whole).alias("leaves"))
    starts = _listed(settle(starts, f"{name}-starts"))
    out = ranged.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_of")))
    place = F.col("_start") + F.col("_id") - F.col("_first")
    return out.select(*rows.columns, place.alias("place"), "leaves")


def _up(level: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        tree, start, n = (table[c][0].as_py() for c in ("tree", "place", "leaves"))
        at, place, found = [], [], []
        for above, nodes in rise(table["hash"].to_pylist(), n, level, most):
            at += [above] * len(nodes)
            place += range(start >> (above - level), (start >> (above - level)) + len(nodes))
            found += nodes
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()
        columns = [tree] * len(at), at, place, found, [n] * len(at)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "level", "place", "hash", "leaves"])

    return run


def _tree_nodes(leaves: DataFrame, name: str) -> DataFrame:
    """All nodes of the trees over ``leaves(tree, place, hash, leaves)``, settled."""
    largest = leaves.agg(F.max("leaves")).first()[0] or 0
    at = leaves.select("tree", "place", "hash", "leaves")
    out = at.select("tree", F.lit(0).alias("level"), "place", "hash")
    for level in range(0, height(largest), RISE):
        runs = at.filter(F.col("leaves") > 1 << level).groupBy("tree", F.shiftright("place", RISE).alias("run"))
        risen = settle(runs.applyInArrow(_up(level, RISE), f"{NODES}, leaves bigint"), f"{name}-{level}")
        out = out.unionByName(risen.select("tree", "level", "place", "hash"))
        at = risen.filter(F.col("level") == level + RISE).select("tree", "place", "hash", "leaves")
    return out


def build(
    docs: DataFrame, key: str = "doc_id", group: str = "lang",
    columns: tuple[str, ...] = COLUMNS, carry: dict[str, Column] | None = None,
) -> Manifest:
    """Leaves and nodes of all rows of ``docs``.

    A leaf is the digest of ``columns``, missing values included. Leaves of a
    group ascend by key, null first, and leaves of equal key by digest; rows
    equal in all columns are interchangeable. Groups ascend by their bytes,
    null first. ``carry`` names further columns that go along with a leaf.
    Without rows there are no leaves, no nodes and no root.
    """
    carry = carry or {}
    rows = docs.select(
        F.col(key).alias("key"), F.col(group).cast("string").alias("_lang"), digest([F.col(c) for c in columns]).alias("leaf"),
        *[c.alias(f"_c_{name}") for name, c in carry.items()],
    )
    rows = settle(rows, "leaves")
    ranked = settle(_ranked(rows, "_lang", ["key", "leaf"], "ranked-leaves"), "placed-leaves")
    # groups are the leaves of the tree above: their number in order names their tree
    groups = ranked.filter("place = 0").select(F.lit(0).alias("_all"), F.col("_lang").alias("_name"), F.col("leaves").alias("_size"))
    groups = _ranked(groups, "_all", ["_name"], "groups")
    groups = settle(groups.select("_name", F.col("place").alias("tree"), "_size", F.col("leaves").alias("trees")), "trees")
    trees = groups.agg(F.max("trees")).first()[0] or 0
    names = _listed(groups.select("_name", "tree"))
    leaves = ranked.join(names, F.col("_lang").eqNullSafe(F.col("_name")))
    leaves = settle(
        leaves.select("key", *[F.col(f"_c_{name}").alias(name) for name in carry], "leaf", "tree", "place", "leaves"), "tree-leaves"
    )
    nodes = _tree_nodes(leaves.withColumnRenamed("leaf", "hash"), "nodes")
    # the top of a tree is at the height of its number of leaves
    tops = nodes.join(_listed(groups), "tree").filter(
        (F.pow(F.lit(2.0), F.col("level")) >= F.col("_size")) & (F.col("place") == 0)
    )
    tops = tops.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("place"), "hash", F.col("trees").alias("leaves"))
    above = _tree_nodes(settle(tops, "tops"), "top-nodes")
    return Manifest(leaves, nodes.unionByName(above), trees)


def prove(manifest: Manifest, leaves: DataFrame | None = None, part: int = PART) -> DataFrame:
    """Leaves with ``steps``, ``siblings``, ``subroot`` and ``root``: of all, or of some rows of ``manifest.leaves``.

    ``steps`` has a letter for each level, see `path`; ``siblings`` are those
    of the levels that have one, from the leaf to the root.
    """
    asked = (manifest.leaves if leaves is None else leaves).withColumn("part", F.floor(F.col("place") / F.lit(part)).cast("bigint"))
    trees = manifest.trees

    def coordinates(table: pa.Table) -> pa.Table:
        tree, group, n = (table[c][0].as_py() for c in ("tree", "part", "leaves"))
        rows = [(tree, level, p) for level, places in missing(table["place"].to_numpy(), n) for p in places.tolist()]
        rows += [(TOP, level, p) for level, places in missing(np.array([tree]), trees) for p in places.tolist()]
        at, level, place = zip(*rows) if rows else ((), (), ())
        return pa.table({
            "of": pa.array([tree] * len(rows), pa.int64()), "part": pa.array([group] * len(rows), pa.int64()),
            "tree": pa.array(at, pa.int64()), "level": pa.array(level, pa.int32()), "place": pa.array(place, pa.int64()),
        })

    wanted = asked.select("tree", "part", "place", "leaves").groupBy("tree", "part").applyInArrow(
        coordinates, "of bigint, part bigint, tree bigint, level int, place bigint"
    )
    wanted = _listed(settle(wanted, "missing-nodes"))
    fetched = wanted.join(manifest.nodes, ["tree", "level", "place"])
    carried = [c for c in asked.columns if c not in ("leaf", "tree", "place", "leaves", "part")]

    def proofs(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not len(mine):
            return out.empty_table()
        tree, n = mine["tree"][0].as_py(), mine["leaves"][0].as_py()
        places, hashes = mine["place"].to_pylist(), mine["leaf"].to_pylist()
        of, level, place, found = (others[c].to_pylist() for c in ("at", "level", "place", "hash"))
        nodes = {(t, a, p): h for t, a, p, h in zip(of, level, place, found)}
        below = {(a, p): h for (t, a, p), h in nodes.items() if t == tree}
        above = {(a, p): h for (t, a, p), h in nodes.items() if t == TOP}
        levels = climb(dict(zip(places, hashes)), below, n)
        subroot = levels[-1][0]
        over = climb({tree: subroot}, above, trees)
        last = path(tree, trees)
        rest = [over[k][(tree >> k) ^ 1] for k, step in enumerate(last) if step != "N"]
        steps, siblings = [], []
        for p in places:
            way = path(p, n)
            steps.append(way + last)
            siblings.append([levels[k][(p >> k) ^ 1] for k, step in enumerate(way) if step != "N"] + rest)
        m = len(places)
        columns = {c: mine[c] for c in carried} | {"leaf": mine["leaf"], "steps": pa.array(steps)}
        columns |= {"siblings": pa.array(siblings, pa.list_(pa.binary())), "subroot": pa.array([subroot] * m), "root": pa.array([over[-1][0]] * m)}
        return pa.table(columns)

    kinds = [f for f in asked.schema.fields if f.name in carried]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "leaf binary, steps string, siblings array<binary>, subroot binary, root binary"])
    out = to_arrow_schema(asked.select(*carried, "leaf").schema)
    out = pa.schema([*out, *_PROOF])
    others = fetched.select("of", "part", F.col("tree").alias("at"), "level", "place", "hash").withColumnRenamed("of", "tree")
    return asked.groupBy("tree", "part").cogroup(others.groupBy("tree", "part")).applyInArrow(proofs, schema)
