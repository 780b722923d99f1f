"""The script rule: decides texts that naive Bayes left unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotsieve.functions import text as tx
from glotsieve.functions.scores import nearest_language
from glotsieve.operators.blocks import cjk_language, script_of_block, top_blocks, unique_chars
from glotsieve.operators.ngrams import Templates, rank_distances
from glotsieve.session import settle
from glotsieve.values import CANDIDATES, CJK, MARGIN, UNKNOWN


def closest_distance(
    df: DataFrame,
    key: str,
    text: str,
    script: str,
    templates: Templates,
    margin: float = MARGIN,
) -> DataFrame:
    """``(key, closest)``: nearest candidate of a text's script group.

    A text shorter than one gram, or of a group without templates, is unknown.
    """
    texts = df.select(key, script, text).repartition(key)
    found = rank_distances(
        texts, [key, script], script, F.col(text), templates
    )
    return found.select(key, nearest_language("distances", margin).alias("closest"))


def rule_inputs(
    texts: DataFrame,
    predictions: DataFrame,
    key: str,
    text: str,
    blocks: DataFrame,
    templates: Templates,
    carry: list[str] | None = None,
) -> DataFrame:
    """``(key, *carry, nb_predict, decided, distances)`` for every text.

    ``decided`` is the label so far: that of naive Bayes, of the script, or of
    a distinctive letter; null where the nearest of ``distances`` decides.

    Only the unknown texts are joined and taken apart; predictions of the others
    are added at the end, without their texts. Every step groups or joins by
    ``key``, which is unique: with texts partitioned by it there is no exchange
    in here.
    """
    carry = list(carry or [])
    # Narrow rows, written once: the plans that read them stay small, and texts
    # are joined with the unknown ones only.
    predictions = settle(predictions.select(key, *carry, "nb_predict"), "predictions")
    unknown = F.col("nb_predict") == UNKNOWN
    by = [key, *carry, "nb_predict"]
    undecided = predictions.filter(unknown).hint("shuffle_hash")
    profile = top_blocks(texts.select(key, text).join(undecided, key), by, tx.letter_runs(text), blocks)
    target = script_of_block("top_block")
    scripts = profile.select(
        *by,
        target.alias("script"),
        cjk_language(F.col("has_kana"), F.col("has_hangul")).alias("cjk_language"),
    ).hint("shuffle_hash")
    shared = F.col("script").isin(list(CANDIDATES))
    decided = (
        F.when(F.col("script") == CJK, F.col("cjk_language"))
        .when(shared, unique_chars(text, "script"))
        .otherwise(F.col("script"))
    )
    labelled = (
        texts.select(key, text)
        .join(scripts, key)
        .select(*by, "script", text, decided.alias("decided"))
    )
    ruled = rank_distances(
        labelled,
        [*by, "script", "decided"],
        "script",
        F.when(F.col("decided").isNull(), F.col(text)),
        templates,
    ).select(*by, "decided", "distances")
    settled = predictions.filter(~unknown).withColumn("decided", F.col("nb_predict"))
    return ruled.unionByName(settled, allowMissingColumns=True)


def rule_label(margin: Column | float = MARGIN) -> Column:
    """Final label of a row of ``rule_inputs``."""
    return F.coalesce("decided", nearest_language("distances", margin))


def unicode_predict(
    texts: DataFrame,
    predictions: DataFrame,
    key: str,
    text: str,
    blocks: DataFrame,
    templates: Templates,
    margin: float = MARGIN,
) -> DataFrame:
    """``(key, nb_predict, unicode_predict)``: labels of naive Bayes where it is
    sure, else those of the script rule."""
    found = rule_inputs(texts, predictions, key, text, blocks, templates)
    return found.select(key, "nb_predict", rule_label(margin).alias("unicode_predict"))
