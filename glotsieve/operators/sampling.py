"""Exact samples and splits that depend on ``(seed, key)`` only.

Rows are ordered by a hash of their key, and a sample of k is the k lowest.
Ranking a whole class in one window would put a third of the corpus into one
task. Instead a class is counted in 65,536 hash ranges, the range in which the
k-th row falls is ranked alone, and its k-th hash becomes the class's cut.
Every other row is then decided by comparing two strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotsieve.functions.text import seeded_hash
from glotsieve.session import attach, settle
from glotsieve.values import FOLDS, SEED, TRAIN_SHARE

_RANGE_DIGITS = 4
_GROUP = "_group"


def _named(group: str) -> Column:
    """A group's name for joins, in which rows without a group are a group of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


class ShortGroup(ValueError):
    """A class holds fewer rows than its quota, or has no quota."""


def _count_ranges(df: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """``(group, range, n_range)``: the one pass over all rows that counts them."""
    head = F.substring(seeded_hash(key, seed), 1, _RANGE_DIGITS)
    counts = df.groupBy(group, head.alias("range")).agg(F.count("*").alias("n_range"))
    return settle(counts, "hash-ranges")


def _flag(
    df: DataFrame, key: str, group: str, ranges: DataFrame, wanted: Column, seed: int
) -> DataFrame:
    """Add ``chosen``: whether a row is among the ``wanted`` lowest of its group.

    ``wanted`` may use the group's size ``n`` and other columns of ``ranges``.
    """
    whole = Window.partitionBy(group)
    so_far = whole.orderBy("range")
    before = F.sum("n_range").over(so_far) - F.col("n_range")
    edges = (
        ranges.withColumn("n", F.sum("n_range").over(whole))
        .withColumn("need", wanted - before)
        .filter((F.col("need") > 0) & (F.col("need") <= F.col("n_range")))
        .select(_named(group).alias(_GROUP), "range", "need")
    )
    groups = ranges.select(group).distinct().count()
    hashed = df.select(_named(group).alias(_GROUP), seeded_hash(key, seed).alias("hash"))
    in_edge = attach(
        hashed.withColumn("range", F.substring("hash", 1, _RANGE_DIGITS)),
        edges,
        [_GROUP, "range"],
        spread_by="hash",
        how="inner",
        rows=groups,
    )
    rank = F.row_number().over(Window.partitionBy(_GROUP, "range").orderBy("hash"))
    cuts = (
        in_edge.withColumn("rank", rank)
        .filter(F.col("rank") == F.col("need"))
        .select(_GROUP, F.col("hash").alias("cut"))
    )
    # A row a group, so what reads the flag later need not rank again.
    cuts = settle(cuts, "cuts")
    chosen = F.coalesce(seeded_hash(key, seed) <= F.col("cut"), F.lit(False))
    flagged = attach(df.withColumn(_GROUP, _named(group)), cuts, _GROUP, spread_by=key, rows=groups)
    return flagged.select(*df.columns, chosen.alias("chosen"))


def split_train_test(
    df: DataFrame,
    key: str,
    group: str = "source",
    train_share: float = TRAIN_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Label rows train or test, to exact sizes within every source."""
    test = F.col("n") - F.bround(F.col("n") * F.lit(float(train_share))).cast("long")
    flagged = _flag(df, key, group, _count_ranges(df, key, group, seed), test, seed)
    split = F.when(F.col("chosen"), "test").otherwise("train")
    return flagged.select(*df.columns, split.alias("split"))


def flag_sampled(
    df: DataFrame,
    key: str,
    quotas: DataFrame,
    group: str = "language",
    seed: int = SEED,
    strict: bool = True,
) -> DataFrame:
    """Add ``sampled``: rows of an exact sample of ``quota`` rows a class.

    ``quotas`` holds ``(group, quota)``. With ``strict``, a class without a
    quota or with fewer rows than it is an error; else all its rows are taken,
    or none where there is no quota.
    """
    ranges = _count_ranges(df, key, group, seed).join(
        quotas.select(group, "quota"), group, "left"
    )
    if strict:
        sizes = ranges.groupBy(group, "quota").agg(F.sum("n_range").alias("n"))
        short = F.col("quota").isNull() | (F.col("quota") > F.col("n"))
        bad = sizes.filter(short).orderBy(group).first()
        if bad is not None:
            raise ShortGroup(f"{bad[group]!r} holds {bad['n']} rows, quota {bad['quota']}")
    wanted = F.least(F.coalesce(F.col("quota"), F.lit(0)).cast("long"), F.col("n"))
    return _flag(df, key, group, ranges, wanted, seed).withColumnRenamed("chosen", "sampled")


def sample_per_language(df: DataFrame, key: str, quotas: DataFrame, **options) -> DataFrame:
    return flag_sampled(df, key, quotas, **options).filter("sampled").drop("sampled")


def unseen_rows(population: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Complement of a sample. Where the flag is at hand, filter on it instead."""
    return population.join(sample.select(key), key, "left_anti")


def sample_n(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """Exactly n rows, or all if there are fewer."""
    whole = df.withColumn("_all", F.lit(1))
    ranges = _count_ranges(whole, key, "_all", seed)
    wanted = F.least(F.col("n"), F.lit(n))
    return _flag(whole, key, "_all", ranges, wanted, seed).filter("chosen").drop("chosen", "_all")


def fold_of(key: Column | str, folds: int = FOLDS, seed: int = SEED) -> Column:
    """Fold number of a key: row-local, so folds need no pass over the data."""
    head = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("long")
    return (head % folds).cast("int")


def assign_folds(df: DataFrame, key: str, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", fold_of(key, folds, seed))
