"""Counts, shares and error rates of labelled predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotsieve.values import ENGLISH, UNKNOWN


def language_counts(df: DataFrame, column: str = "language") -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def split_shares(df: DataFrame, column: str = "split") -> DataFrame:
    """Share of rows by label. The total is taken over the counts, one row a label."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(column, (F.col("n") / total).alias("share"))


def accuracy(truth: Column, predicted: Column) -> Column:
    """Percentage of right labels; UNKNOWN and a missing prediction count as wrong."""
    return F.avg(truth.eqNullSafe(predicted).cast("double")) * 100


def false_negative_rate(truth: Column, predicted: Column) -> Column:
    """Percentage of English texts called anything else; null without English."""
    english = truth == ENGLISH
    missed = F.count_if(english & ~predicted.eqNullSafe(ENGLISH))
    return F.try_divide(missed, F.count_if(english)) * 100


def false_positive_rate(truth: Column, predicted: Column) -> Column:
    """Percentage of other texts called English; null without any."""
    other = ~truth.eqNullSafe(ENGLISH)
    taken = F.count_if(other & (predicted == ENGLISH))
    return F.try_divide(taken, F.count_if(other)) * 100


def rates(truth: Column | str, predicted: Column | str) -> list[Column]:
    """The three figures as aggregates, for any grouping."""
    truth = F.col(truth) if isinstance(truth, str) else truth
    predicted = F.col(predicted) if isinstance(predicted, str) else predicted
    return [
        accuracy(truth, predicted).alias("accuracy"),
        false_negative_rate(truth, predicted).alias("fnr"),
        false_positive_rate(truth, predicted).alias("fpr"),
    ]


def metrics_report(df: DataFrame, prefix: str, truth: str, predicted: str) -> DataFrame:
    """``(metric, value)``: figures to two decimals, named with a prefix."""
    figures = df.agg(*rates(truth, predicted))
    names = {"accuracy": "accuracy", "fnr": "FNR", "fpr": "FPR"}
    lines = F.array(
        *[
            F.struct(
                F.lit(f"{prefix} {name}").alias("metric"), F.round(column, 2).alias("value")
            )
            for column, name in names.items()
        ]
    )
    return figures.select(F.inline(lines))


def stage_comparison(df: DataFrame, truth: str, stages: dict[str, str]) -> DataFrame:
    """``(stage, accuracy, fnr, fpr)`` for prediction columns, in one pass.

    ``stages`` maps a stage's name to its prediction column.
    """
    each = F.array(
        *[
            F.struct(F.lit(stage).alias("stage"), F.col(column).alias("predicted"))
            for stage, column in stages.items()
        ]
    )
    long = df.select(F.col(truth).alias("truth"), F.inline(each))
    return long.groupBy("stage").agg(*rates("truth", "predicted"))


def unknown_profile(df: DataFrame, predicted: str = "nb_predict") -> DataFrame:
    """What texts left unknown look like on average."""
    return df.filter(F.col(predicted) == UNKNOWN).agg(
        F.count("*").alias("n"),
        F.avg("text_length").alias("mean_length"),
        F.avg("threshold").alias("mean_threshold"),
        F.avg("best_prob").alias("mean_best_prob"),
    )
