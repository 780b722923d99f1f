"""Training, storing and applying the whole classifier."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glotsieve.functions.text import clean_text
from glotsieve.operators.naive_bayes import NaiveBayesModel, nb_fit, nb_predict
from glotsieve.operators.ngrams import Templates, train_ngrams
from glotsieve.operators.rule import rule_inputs, rule_label
from glotsieve.operators.subwords import SubwordVocabulary, train_subwords
from glotsieve.operators.vocabulary import WordVocabulary, train_word_vocabulary, word_counts
from glotsieve.session import settle
from glotsieve.sources.blocks import jvm_blocks
from glotsieve.values import (
    ALPHA,
    GRAM_SIZE,
    MARGIN,
    TEMPLATE_SIZE,
    THRESHOLD,
    VOCABULARY_SIZE,
)


@dataclass(frozen=True)
class Detector:
    """Everything a text is judged by: three small tables and three numbers."""

    bayes: NaiveBayesModel
    templates: Templates
    threshold: float = THRESHOLD
    margin: float = MARGIN


def train_detector(
    df: DataFrame,
    text: str = "text",
    language: str = "language",
    tokens: str = "subword",
    size: int = VOCABULARY_SIZE,
    alpha: float = ALPHA,
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
) -> Detector:
    """Train on the rows given, usually the train split.

    ``tokens`` is ``subword`` or ``word``. Texts are cleaned and written once, and
    read twice, to count words and to count n-grams; the rest works on those counts.
    """
    cleaned = settle(df.select(clean_text(text).alias("text"), F.col(language).alias("language")), "cleaned")
    train = {"subword": train_subwords, "word": train_word_vocabulary}[tokens]
    counts = settle(word_counts(cleaned, by=["language"]), "word-counts")
    return Detector(
        nb_fit(cleaned, train(counts, size), alpha=alpha, counts=counts),
        train_ngrams(cleaned, n=GRAM_SIZE, k=TEMPLATE_SIZE),
        threshold,
        margin,
    )


_DIGEST = "_digest"


def text_digest(text: str) -> Column:
    """What the label of a text depends on: its cleaned form."""
    return F.sha2(clean_text(text), 256)


def label_texts(
    df: DataFrame, text: str, detector: Detector, blocks: DataFrame | None = None
) -> DataFrame:
    """``(_digest, predicted_language)``: one row for each different cleaned text.

    Copies are merged within tasks, so a text that a third of all rows repeat
    moves once a task. Texts are exchanged by digest, for naive Bayes and again
    for the script rule, which joins those left unknown only.
    """
    return _label_cleaned(_cleaned(df, text), detector, blocks)


def _cleaned(df: DataFrame, text: str, *columns: str) -> DataFrame:
    return df.select(*columns, text_digest(text).alias(_DIGEST), clean_text(text).alias("_clean"))


def _label_cleaned(texts: DataFrame, detector: Detector, blocks: DataFrame | None = None) -> DataFrame:
    blocks = blocks if blocks is not None else jvm_blocks(texts.sparkSession)
    # Written once: naive Bayes and the script rule both read the texts.
    texts = settle(texts.groupBy(_DIGEST).agg(F.first("_clean").alias("_clean")), "texts")
    predictions = nb_predict(texts, _DIGEST, "_clean", detector.bayes, detector.threshold)
    found = rule_inputs(texts, predictions, _DIGEST, "_clean", blocks, detector.templates)
    return found.select(_DIGEST, rule_label(detector.margin).alias("predicted_language"))


def detect_language(
    df: DataFrame,
    text: str,
    detector: Detector,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """All columns of ``df`` and ``predicted_language``; every row comes back once.

    Texts are judged by what they hold, so a table needs no key, and null or
    repeated keys do no harm. Labels are the hashed side of the last join, so
    the wide rows are neither sorted nor held.
    """
    labels = label_texts(df, text, detector, blocks)
    joined = df.withColumn(_DIGEST, text_digest(text)).join(labels.hint("shuffle_hash"), _DIGEST, "left")
    return joined.select(*df.columns, "predicted_language")


def detect_labels(
    df: DataFrame, text: str, key: str, detector: Detector, blocks: DataFrame | None = None
) -> DataFrame:
    """``(key, predicted_language)`` of every row: the narrow result, cheapest at scale.

    Texts are cleaned and hashed once; the last join reads keys and digests only.
    """
    rows = settle(_cleaned(df, text, key), "rows")
    labels = _label_cleaned(rows.select(_DIGEST, "_clean"), detector, blocks)
    joined = rows.select(key, _DIGEST).join(labels.hint("shuffle_hash"), _DIGEST, "left")
    return joined.select(key, "predicted_language")


def save_detector(detector: Detector, path: str) -> None:
    """Write the model tables as parquet and the numbers as one JSON line."""
    bayes, templates = detector.bayes, detector.templates
    spark = bayes.terms.sparkSession
    numbers = {
        "languages": bayes.languages,
        "docs": bayes.docs,
        "tokens": bayes.tokens,
        "alpha": bayes.alpha,
        "size": bayes.vocabulary.size,
        "subwords": isinstance(bayes.vocabulary, SubwordVocabulary),
        "sizes": dict(templates.sizes),
        "n": templates.n,
        "k": templates.k,
        "threshold": detector.threshold,
        "margin": detector.margin,
    }
    bayes.vocabulary.table.write.parquet(f"{path}/vocabulary")
    bayes.terms.write.parquet(f"{path}/terms")
    templates.table.write.parquet(f"{path}/templates")
    line = spark.createDataFrame([(json.dumps(numbers),)], "value STRING")
    line.coalesce(1).write.text(f"{path}/numbers")


def load_detector(spark: SparkSession, path: str) -> Detector:
    numbers = json.loads(spark.read.text(f"{path}/numbers").first().value)
    table = spark.read.parquet(f"{path}/vocabulary")
    kind = SubwordVocabulary if numbers["subwords"] else WordVocabulary
    bayes = NaiveBayesModel(
        languages=tuple(numbers["languages"]),
        docs=tuple(numbers["docs"]),
        tokens=tuple(numbers["tokens"]),
        terms=spark.read.parquet(f"{path}/terms"),
        vocabulary=kind(table, numbers["size"]),
        alpha=numbers["alpha"],
    )
    templates = Templates(
        spark.read.parquet(f"{path}/templates"), numbers["sizes"], numbers["n"], numbers["k"]
    )
    return Detector(bayes, templates, numbers["threshold"], numbers["margin"])
