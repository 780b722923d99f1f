"""Cross-validated tuning of smoothing, threshold and margin.

No model is fitted for a fold. Tokens are counted once by fold; what a model
that leaves a fold out knows is the total less that fold. Every text then
meets all held-out models in one pass, and the values tried are columns or
row-local arrays, not further passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotsieve.functions.scores import confidence_threshold
from glotsieve.operators.metrics import rates
from glotsieve.operators.naive_bayes import MAX_CELLS, count_terms
from glotsieve.operators.rule import rule_label
from glotsieve.operators.sampling import fold_of
from glotsieve.operators.vocabulary import word_counts
from glotsieve.session import attach, settle, spread
from glotsieve.values import (
    ALPHA,
    ALPHAS,
    ENGLISH,
    FOLDS,
    MARGINS,
    SEED,
    THRESHOLDS,
    TUNING_THRESHOLD,
    UNKNOWN,
)


def cv_predictions(
    df: DataFrame,
    key: str,
    text: str,
    language: str,
    vocabulary,
    alphas: list[float],
    folds: int = FOLDS,
    seed: int = SEED,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``(key, truth, text_length, part, model, alpha, best_predict, best_prob)``.

    ``model`` is the fold left out; ``part`` tells whether the text was in it
    (test) or trained on (train). ``counts``: ``fold_counts``, if they were made
    before.
    """
    spark = df.sparkSession
    fold = fold_of(key, folds, seed).alias("fold")
    texts = df.select(key, F.col(language).alias("language"), F.col(text).alias("text"), fold)
    if counts is None:
        counts = word_counts(texts, "text", ["language", "fold"])
    terms = settle(count_terms(counts, ["language", "fold"], vocabulary), "fold-terms")
    docs = texts.groupBy("language", "fold").agg(F.count("*").alias("docs"))
    tokens = terms.groupBy("language", "fold").agg(F.sum("n").alias("tokens"))
    classes = docs.join(tokens, ["language", "fold"], "left").collect()
    names = sorted({r.language for r in classes})
    models = spark.createDataFrame(
        _model_rows(classes, names, vocabulary.size, alphas, folds),
        "model INT, alpha DOUBLE, place INT, classes ARRAY<STRUCT<id: INT, prior: DOUBLE, base: DOUBLE>>",
    )
    known = _held_out_gains(terms, names, alphas, folds)

    # One exchange of texts serves the counts of tokens, the sums by class and the sizes.
    moved = spread(texts, key, "text")
    units = moved.select(key, F.explode(vocabulary.units("text")).alias("unit"))
    counted = vocabulary.with_tokens(units, key).groupBy(key, "token").agg(
        F.count("*").alias("m")
    )
    cells = vocabulary.size * folds * len(names) * len(alphas)
    found = attach(
        counted, known, "token", key, how="inner",
        rows=vocabulary.size,
        max_rows=vocabulary.size if cells <= MAX_CELLS else 0,
    )

    # A class and a text meet once; models and values tried are columns.
    def gain(model: int, place: int) -> Column:
        return F.sum(F.col("m") * F.get("logs", F.lit(model * len(alphas) + place)))

    gains = F.array(*[F.array(*[gain(m, i) for i in range(len(alphas))]) for m in range(folds)])
    matched = (
        found.select(key, "m", F.inline("entries"))
        .groupBy(key, "id")
        .agg(gains.alias("gains"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("id", "gains"))).alias("gains"))
    )
    sizes = moved.select(
        key,
        F.col("language").alias("truth"),
        F.length("text").alias("text_length"),
        F.coalesce(F.size(vocabulary.units("text")), F.lit(0)).alias("n_tokens"),
        "fold",
    )

    def joint(c: Column) -> Column:
        of_class = F.try_element_at("gains", c["id"])
        gain = F.get(F.get(of_class, F.col("model")), F.col("place"))
        score = c["prior"] + F.col("n_tokens") * c["base"] + F.coalesce(gain, F.lit(0.0))
        # Of equal scores the class first in name is the greatest.
        return F.struct(score.alias("score"), (-c["id"]).alias("order"))

    best = F.col("best.score")
    total = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.exp(s["score"] - best))
    labels = F.array(*[F.lit(x) for x in names])
    each_model = F.explode(F.array(*[F.lit(m) for m in range(folds)])).alias("model")
    return (
        sizes.join(matched.hint("shuffle_hash"), key, "left")
        .select("*", each_model)
        .join(F.broadcast(models), "model")
        .withColumn("scores", F.transform("classes", joint))
        .withColumn("best", F.array_max("scores"))
        .select(
            key,
            "truth",
            "text_length",
            F.when(F.col("fold") == F.col("model"), "test").otherwise("train").alias("part"),
            "model",
            "alpha",
            F.get(labels, -F.col("best.order")).alias("best_predict"),
            (F.lit(1.0) / total).alias("best_prob"),
        )
    )


def _model_rows(classes, names, size: int, alphas, folds: int) -> list[tuple]:
    """Priors and denominators of every held-out model: folds x values tried."""
    rows = []
    for model in range(folds):
        docs = {n: 0 for n in names}
        tokens = {n: 0 for n in names}
        for r in classes:
            if r.fold != model:
                docs[r.language] += r.docs
                tokens[r.language] += r.tokens or 0
        total = sum(docs.values())
        for place, a in enumerate(alphas):
            entries = [
                (i, math.log(docs[n] / total), math.log(a) - math.log(tokens[n] + a * size))
                for i, n in enumerate(names)
                if docs[n]
            ]
            rows.append((model, float(a), place, entries))
    return rows


def fold_counts(
    df: DataFrame, key: str, text: str, language: str, folds: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """``(language, fold, word, n)``, from which a vocabulary can be trained as well."""
    fold = fold_of(key, folds, seed).alias("fold")
    texts = df.select(F.col(language).alias("language"), F.col(text).alias("text"), fold)
    return word_counts(texts, "text", ["language", "fold"])


def _held_out_gains(terms: DataFrame, names: list[str], alphas: list[float], folds: int) -> DataFrame:
    """``(token, entries)``: for each class of a token, what it adds to a score.

    ``logs`` has a value for each held-out model and smoothing, in this order, so
    no logarithm is taken for a text. One row a token and at most one entry a
    class in it, so never more than the vocabulary times the number of classes.
    """
    by_fold = [
        F.coalesce(F.sum(F.when(F.col("fold") == m, F.col("n"))), F.lit(0)).alias(f"f{m}")
        for m in range(folds)
    ]
    ids = F.create_map(*[F.lit(x) for pair in ((n, i) for i, n in enumerate(names)) for x in pair])
    logs = F.array(
        *[
            F.log(F.col("total") - F.col(f"f{m}") + alpha) - F.lit(math.log(alpha))
            for m in range(folds)
            for alpha in alphas
        ]
    )
    return (
        terms.groupBy("token", "language")
        .agg(F.sum("n").alias("total"), *by_fold)
        .select("token", F.try_element_at(ids, F.col("language")).alias("id"), logs.alias("logs"))
        .groupBy("token")
        .agg(F.collect_list(F.struct("id", "logs")).alias("entries"))
    )


def cv_table(predicted: DataFrame, parameter: str, truth: str, label: str) -> DataFrame:
    """Mean figures over models, one row a value tried.

    Means leave out folds without English, or without other texts.
    """
    return mean_table(predicted.groupBy(parameter, "part", "model").agg(*rates(truth, label)), parameter)


def mean_table(by_model: DataFrame, parameter: str) -> DataFrame:
    def mean(part: str, figure: str) -> Column:
        return F.avg(F.when(F.col("part") == part, F.col(figure)))

    figures = {"score": "accuracy", "fnr": "fnr", "fpr": "fpr"}
    return by_model.groupBy(parameter).agg(
        *[
            mean(part, figure).alias(f"{part}_{name}")
            for part in ("train", "test")
            for name, figure in figures.items()
        ]
    )


def _verdict(threshold: Column) -> Column:
    return F.when(F.col("best_prob") >= threshold, F.col("best_predict")).otherwise(UNKNOWN)


def nb_tune_alpha(
    df: DataFrame,
    key: str,
    text: str,
    language: str,
    vocabulary,
    alphas: list[float] = ALPHAS,
    t: float = TUNING_THRESHOLD,
    counts: DataFrame | None = None,
) -> DataFrame:
    scored = cv_predictions(df, key, text, language, vocabulary, alphas, counts=counts)
    label = _verdict(confidence_threshold("text_length", t))
    return cv_table(scored.withColumn("label", label), "alpha", "truth", "label")


def nb_tune_threshold(
    df: DataFrame,
    key: str,
    text: str,
    language: str,
    vocabulary,
    alpha: float = ALPHA,
    thresholds: list[float] = THRESHOLDS,
    counts: DataFrame | None = None,
) -> DataFrame:
    scored = cv_predictions(df, key, text, language, vocabulary, [alpha], counts=counts)
    tried = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t")
    each = scored.select("truth", "part", "model", "text_length", "best_predict", "best_prob", tried)
    label = _verdict(confidence_threshold("text_length", F.col("t")))
    return cv_table(each.withColumn("label", label), "t", "truth", "label")


def unicode_tune_margin(
    inputs: DataFrame,
    key: str,
    truth: str,
    margins: list[float] = MARGINS,
    folds: int = FOLDS,
    seed: int = SEED,
) -> DataFrame:
    """``inputs`` are ``rule_inputs`` that carry the true label.

    Templates are not refitted, so distances hold for all folds and values.
    """
    tried = F.array(*[F.lit(float(m)) for m in margins])
    labelled = inputs.withColumn("margin", F.explode(tried)).select(
        "margin", fold_of(key, folds, seed).alias("fold"), truth,
        rule_label(F.col("margin")).alias("label"),
    )
    # Counts by own fold, a row each; a model that leaves a fold out was
    # trained on the total less that fold.
    english, hit = F.col(truth) == ENGLISH, F.col("label") == ENGLISH
    counts = labelled.groupBy("margin", "fold").agg(
        F.count("*").alias("all"),
        F.count_if(F.col(truth).eqNullSafe(F.col("label"))).alias("right"),
        F.count_if(english).alias("english"),
        F.count_if(english & ~F.coalesce(hit, F.lit(False))).alias("missed"),
        F.count_if(~F.coalesce(english, F.lit(False))).alias("other"),
        F.count_if(~F.coalesce(english, F.lit(False)) & hit).alias("taken"),
    )
    names = ["all", "right", "english", "missed", "other", "taken"]
    model = F.explode(F.array(*[F.lit(m) for m in range(folds)])).alias("model")
    # Read twice below: a row for each margin and fold, written once, so that
    # texts are judged once.
    counts = settle(counts, "margin-counts")
    # A margin may have no text of a fold; that model is tested on nothing.
    totals = counts.groupBy("margin").agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    own = counts.withColumnRenamed("fold", "model")
    each = totals.select("*", model).join(own, ["margin", "model"], "left").fillna(0, names)
    parts = F.array(
        F.struct(F.lit("test").alias("part"), *[F.col(n) for n in names]),
        F.struct(F.lit("train").alias("part"), *[(F.col(f"t_{n}") - F.col(n)).alias(n) for n in names]),
    )
    by_model = each.select("margin", "model", F.inline(parts)).select(
        "margin", "model", "part",
        (F.try_divide("right", "all") * 100).alias("accuracy"),
        (F.try_divide("missed", "english") * 100).alias("fnr"),
        (F.try_divide("taken", "other") * 100).alias("fpr"),
    )
    return mean_table(by_model, "margin")
