"""Token vocabularies: ids of words, and the token tables made with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotsieve.functions.text import words
from glotsieve.operators.topk import largest_rows
from glotsieve.session import attach, settle, spread
from glotsieve.values import VOCABULARY_SIZE

OUT_OF_VOCABULARY = 0


@dataclass(frozen=True)
class WordVocabulary:
    """The most frequent words, ids from 1; id 0 stands for any other word.

    ``table`` holds ``(unit, token)`` and at most ``size - 1`` rows.
    """

    table: DataFrame
    size: int

    #: The id a unit gets that is not in the table.
    default: int | None = OUT_OF_VOCABULARY

    def units(self, text: Column | str) -> Column:
        return words(text)

    def with_tokens(self, df: DataFrame, spread_by: str) -> DataFrame:
        """Add ``token`` to a table with a ``unit`` column; null units stay null."""
        found = attach(df, self.table, "unit", spread_by, rows=self.size)
        token = F.when(
            F.col("unit").isNotNull(), F.coalesce("token", F.lit(OUT_OF_VOCABULARY))
        )
        return found.withColumn("token", token)

    def by_unit(self, by_token: DataFrame) -> DataFrame:
        """Turn a table keyed by ``token`` into one keyed by ``unit``."""
        return self.table.join(by_token, "token", "left").drop("token")


def word_counts(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """``(*by, word, n)``: how often each word occurs, in a class or over all.

    Counts are combined within tasks before they move. Vocabularies and models
    are made from this table, so a corpus is read for it once.
    """
    by = by or []
    return (
        df.select(*by, F.explode(words(text)).alias("word"))
        .groupBy(*by, "word")
        .agg(F.count("*").alias("n"))
    )


def word_vocabulary(counts: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """``(token, word, n)``: ids by falling frequency, equal ones by word.

    ``counts`` are ``word_counts``, settled. The ordering that assigns ids sees
    the chosen words only.
    """
    totals = counts.groupBy("word").agg(F.sum("n").alias("n"))
    best = largest_rows(totals, "n", "word", size - 1)
    token = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return best.select(token.alias("token"), "word", "n")


def train_word_vocabulary(counts: DataFrame, size: int = VOCABULARY_SIZE) -> WordVocabulary:
    table = word_vocabulary(counts, size).select(F.col("word").alias("unit"), "token")
    return WordVocabulary(settle(table, "vocabulary"), size)


def tokenize(df: DataFrame, key: str, text: str, vocabulary) -> DataFrame:
    """``(key, tokens)``: the ids of a text in order, as an array.

    Texts are exchanged once, by key; their tokens stay in the task.
    """
    texts = spread(df.select(key, F.col(text).alias("_text")), key, "_text")
    units = texts.select(
        key, F.posexplode_outer(vocabulary.units("_text")).alias("position", "unit")
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", "token")))
    return (
        vocabulary.with_tokens(units, key)
        .groupBy(key)
        .agg(F.transform(ordered, lambda x: x["token"]).alias("tokens"))
        .select(key, F.filter("tokens", lambda x: x.isNotNull()).alias("tokens"))
    )


def vectorize(tokens: DataFrame, key: str, end: int = VOCABULARY_SIZE) -> DataFrame:
    """``(key, token, n)``: counts over ids ``0 .. end - 1``; others are ignored."""
    return (
        tokens.select(key, F.explode("tokens").alias("token"))
        .filter(F.col("token").between(0, end - 1))
        .groupBy(key, "token")
        .agg(F.count("*").alias("n"))
    )
