"""Projection, filter, union, deduplication and previews of labelled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotsieve.values import REMOVE


def add_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source", F.lit(name))


def standardise_columns(df: DataFrame, text: str, language: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.col(text).alias("text"), F.col(language).alias("language"))


def reorder_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Put a copy of the text, ``raw``, in front; ``text`` is cleaned later."""
    return df.select(F.col(text).alias("raw"), *df.columns)


def drop_column(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def filter_languages(df: DataFrame, codes: list[str], column: str = "language") -> DataFrame:
    return df.filter(F.col(column).isin(codes))


def filter_removed(df: DataFrame, column: str = "language") -> DataFrame:
    """Rows that are not struck out; a missing label stays."""
    return df.filter(~F.col(column).eqNullSafe(REMOVE))


def relabelled_rows(df: DataFrame, original: str = "original_language") -> DataFrame:
    """Rows whose label was corrected; two missing labels count as equal."""
    return df.filter(~F.col(original).eqNullSafe(F.col("language")))


def filter_split(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def dedup_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """One of each set of equal rows; with a key, the row of the smallest key.

    Equal rows are merged inside every task before anything moves, so a text
    copied a billion times reaches its reducer once a task.
    """
    if key is None:
        return df.dropDuplicates()
    columns = [c for c in df.columns if c != key]
    return df.groupBy(*columns).agg(F.min(key).alias(key)).select(*df.columns)


def count_removed(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows ``dedup_rows`` drops, in one pass."""
    copies = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))


def preview_rows(df: DataFrame, order: Column | str, n: int = 5) -> DataFrame:
    """The first rows in an order: a top-k, so no global sort."""
    return df.orderBy(order).limit(n)
