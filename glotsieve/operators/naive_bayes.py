"""Multinomial naive Bayes over count tables.

A model is two count tables, ``(language, token, n)`` and one row a class.
Logarithms are taken when texts are scored, so one set of counts serves any
smoothing. Scoring explodes tokens next to a broadcast table of at most one
row a token and one column a class; the sums are combined within each task,
and only one row a text is exchanged, or none if rows already sit by key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotsieve.functions.scores import confidence_threshold
from glotsieve.operators.vocabulary import word_counts
from glotsieve.session import attach, settle
from glotsieve.values import ALPHA, ENGLISH, THRESHOLD, UNKNOWN

# Cells (tokens x classes) of a weight table that is still broadcast: 256 MB.
MAX_CELLS = 32_000_000


@dataclass(frozen=True)
class NaiveBayesModel:
    languages: tuple[str, ...]  # in order of name
    docs: tuple[int, ...]
    tokens: tuple[int, ...]
    terms: DataFrame  # language, token, n; settled
    vocabulary: object
    alpha: float = ALPHA

    def log_priors(self) -> list[float]:
        total = sum(self.docs)
        return [math.log(n / total) for n in self.docs]

    def log_totals(self) -> list[float]:
        """Log denominators: every id of the vocabulary is smoothed, seen or not."""
        return [math.log(n + self.alpha * self.vocabulary.size) for n in self.tokens]


def count_terms(counts: DataFrame, by: list[str], vocabulary) -> DataFrame:
    """``(*by, token, n)`` from the ``word_counts`` of classes.

    Only distinct words are turned into tokens, not every occurrence.
    """
    units = counts.select(*by, "n", F.explode(vocabulary.units("word")).alias("unit"))
    return (
        vocabulary.with_tokens(units, "unit")
        .filter(F.col("token").between(0, vocabulary.size - 1))
        .groupBy(*by, "token")
        .agg(F.sum("n").alias("n"))
    )


def nb_fit(
    df: DataFrame,
    vocabulary,
    text: str = "text",
    language: str = "language",
    alpha: float = ALPHA,
    counts: DataFrame | None = None,
) -> NaiveBayesModel:
    """``counts``: word counts by ``language``, if they were made before."""
    labelled = df.select(F.col(language).alias("language"), text)
    if counts is None:
        counts = word_counts(labelled, text, ["language"])
    terms = settle(count_terms(counts, ["language"], vocabulary), "nb-terms")
    return model_of_counts(class_docs(labelled), terms, vocabulary, alpha)


def class_docs(df: DataFrame) -> DataFrame:
    return df.groupBy("language").agg(F.count("*").alias("n_docs"))


def model_of_counts(
    classes: DataFrame, terms: DataFrame, vocabulary, alpha: float = ALPHA
) -> NaiveBayesModel:
    tokens = terms.groupBy("language").agg(F.sum("n").alias("n_tokens"))
    # A row a class: as few as there are languages.
    rows = classes.join(tokens, "language", "left").orderBy("language").collect()
    if not rows:
        raise ValueError("a model needs at least one class")
    return NaiveBayesModel(
        languages=tuple(r.language for r in rows),
        docs=tuple(r.n_docs for r in rows),
        tokens=tuple(r.n_tokens or 0 for r in rows),
        terms=terms,
        vocabulary=vocabulary,
        alpha=alpha,
    )


def _weights(model: NaiveBayesModel) -> tuple[DataFrame, list[float]]:
    """Log likelihoods ``w0, w1, ...`` by unit, and those of any other unit."""
    totals = model.log_totals()
    counts = (
        model.terms.groupBy("token")
        .pivot("language", list(model.languages))
        .agg(F.sum("n"))
        .toDF("token", *[f"n{i}" for i in range(len(totals))])
    )

    def weight(i: int) -> Column:
        return F.log(F.coalesce(F.col(f"n{i}"), F.lit(0)) + model.alpha) - F.lit(totals[i])

    by_unit = model.vocabulary.by_unit(counts)
    table = by_unit.select("unit", *[weight(i).alias(f"w{i}") for i in range(len(totals))])
    # Any other unit has the default token, if there is one; a row a class.
    seen = model.terms.filter(F.col("token").eqNullSafe(F.lit(model.vocabulary.default)))
    by_language = {r.language: r.n for r in seen.collect()}
    default = [by_language.get(language, 0) for language in model.languages]
    return table, [math.log(n + model.alpha) - t for n, t in zip(default, totals)]


def joint_log_likelihoods(
    df: DataFrame, key: str, text: str, model: NaiveBayesModel
) -> DataFrame:
    """``(key, text_length, j0, j1, ...)``, one column a class, one row a text.

    A text without tokens keeps its row and scores by the priors alone.
    """
    table, other = _weights(model)
    units = df.select(
        key,
        F.length(text).alias("text_length"),
        F.explode_outer(model.vocabulary.units(text)).alias("unit"),
    )
    cells = model.vocabulary.size * len(model.languages)
    found = attach(
        units, table, "unit", key,
        rows=model.vocabulary.size,
        max_rows=model.vocabulary.size if cells <= MAX_CELLS else 0,
    )
    some = F.col("unit").isNotNull()
    sums = [
        F.sum(F.coalesce(F.col(f"w{i}"), F.when(some, F.lit(w)))).alias(f"s{i}")
        for i, w in enumerate(other)
    ]
    scored = found.groupBy(key).agg(F.max("text_length").alias("text_length"), *sums)
    joint = [
        (F.lit(prior) + F.coalesce(F.col(f"s{i}"), F.lit(0.0))).alias(f"j{i}")
        for i, prior in enumerate(model.log_priors())
    ]
    return scored.select(key, "text_length", *joint)


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def nb_scores(df: DataFrame, key: str, text: str, model: NaiveBayesModel) -> DataFrame:
    """``(key, language, log_likelihood, probability)``: one row a class."""
    scored = joint_log_likelihoods(df, key, text, model)
    joint = [F.col(f"j{i}") for i in range(len(model.languages))]
    top = _greatest(joint)
    total = sum((F.exp(j - top) for j in joint), F.lit(0.0))
    each = F.array(
        *[
            F.struct(
                F.lit(language).alias("language"),
                joint[i].alias("log_likelihood"),
                (F.exp(joint[i] - F.col("_top")) / F.col("_total")).alias("probability"),
            )
            for i, language in enumerate(model.languages)
        ]
    )
    return (
        scored.withColumn("_top", top)
        .withColumn("_total", total)
        .select(key, F.explode(each).alias("s"))
        .select(key, "s.*")
    )


def nb_best(df: DataFrame, key: str, text: str, model: NaiveBayesModel) -> DataFrame:
    """``(key, text_length, best_predict, best_prob)``; of equals, the first by name."""
    scored = joint_log_likelihoods(df, key, text, model)
    joint = [F.col(f"j{i}") for i in range(len(model.languages))]
    top = F.col("_top")
    best = F.lit(None).cast("string")
    for language, j in reversed(list(zip(model.languages, joint))):
        best = F.when(j == top, F.lit(language)).otherwise(best)
    total = sum((F.exp(j - top) for j in joint), F.lit(0.0))
    return scored.withColumn("_top", _greatest(joint)).select(
        key,
        "text_length",
        best.alias("best_predict"),
        (F.lit(1.0) / total).alias("best_prob"),
    )


def nb_predict(
    df: DataFrame, key: str, text: str, model: NaiveBayesModel, t: float = THRESHOLD
) -> DataFrame:
    """Best class, its probability, the threshold for the length, and the verdict."""
    best = nb_best(df, key, text, model)
    return apply_threshold(best.withColumn("threshold", confidence_threshold("text_length", t)))


def apply_threshold(best: DataFrame) -> DataFrame:
    sure = F.col("best_prob") >= F.col("threshold")
    return best.withColumn(
        "nb_predict", F.when(sure, F.col("best_predict")).otherwise(UNKNOWN)
    )


def nb_ascii_override(predicted: DataFrame, ascii_flag: Column | str) -> DataFrame:
    """Earlier rule: a doubtful text of ASCII characters only is called English."""
    flag = F.col(ascii_flag) if isinstance(ascii_flag, str) else ascii_flag
    doubtful = (F.col("best_prob") < F.col("threshold")) & (flag == "Eng Unicode")
    return predicted.withColumn(
        "nb_predict", F.when(doubtful, ENGLISH).otherwise(F.col("nb_predict"))
    )
