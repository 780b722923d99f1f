"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glotsieve.session import settle

LEARN_FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept(keep: Iterable[str], own: Iterable[str]) -> list[Column]:
    """Columns to carry along; one named as a column of the result (``own``) is ``kept_`` and its name there."""
    taken = {name.lower() for name in own}
    return [F.col(c).alias(f"kept_{c}") if c.lower() in taken else F.col(c) for c in keep]


def held_out(key: str):
    """True for the fifth of the rows whose labels nothing may learn from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % LEARN_FOLDS == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """The smallest node reachable from each node of ``edges(a, b)``: (node, component).

    Large-star and small-star rounds in turn. Both are a grouped minimum and a
    join, so a node with very many neighbours is combined before the shuffle
    and split by the skew join; no neighbourhood is gathered in one row. The
    number of rounds grows with the logarithm of the longest chain. Every
    round is written to the shared folder, so a lost executor costs a re-read.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = settle(edges.select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), name)
    before = None
    while True:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(
            edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: neighbours above u go to the smallest node around u
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.filter("a < b").distinct()
        # small star: neighbours below u, and u, go to the smallest of them
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").select(
            F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")
        )
        edges = settle(small.filter("a < b").distinct(), name)
        # the sums tell whether a round changed anything
        state = edges.agg(
            F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, key: str, text: str, max_bytes: int | None = None
) -> DataFrame:
    """(key, text, label): up to ``limit`` labelled rows a class that a model may learn from.

    Rows whose ``crc32(key) mod 5`` is 0 are held out and never among them;
    those with the smallest hashes of the key are taken, so a rerun agrees.
    Labels other than 0 and 1 are left out, as are null texts and, if
    ``max_bytes`` is given, texts longer than that. A key that occurs often
    counts once, with the text of the smallest hash. The chosen keys are at most ``2 * limit`` narrow rows, which
    is why they may be broadcast.
    """
    usable = labels.filter(F.col(key).isNotNull() & ~held_out(key) & F.col(label).isin(0, 1))
    usable = usable.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    order = [F.xxhash64("_key"), F.col("_key"), F.col("label")]
    chosen = [usable.filter(F.col("label") == c).orderBy(*order).limit(limit) for c in (0, 1)]
    chosen = chosen[0].union(chosen[1]).groupBy("_key").agg(F.max("label").alias("label"))
    given = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).filter("text is not null")
    if max_bytes is not None:
        given = given.filter(F.octet_length("text") <= max_bytes)
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    return given.join(F.broadcast(chosen), "_key").groupBy("_key", "label").agg(first.alias("text")).select("_key", "text", "label")


def class_counts(labels: DataFrame, label: str, key: str) -> tuple[int, int]:
    """Rows of class 0 and of class 1 among all labels a model may learn from."""
    usable = labels.filter(F.col(key).isNotNull() & ~held_out(key))
    return tuple(usable.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first())
