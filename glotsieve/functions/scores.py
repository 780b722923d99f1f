"""Scalar decision functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glotsieve.values import ENGLISH, SHORT_TEXT, THRESHOLD, UNKNOWN


def confidence_threshold(length: Column | str, t: Column | float = THRESHOLD) -> Column:
    """Probability a text of that length must reach: stricter for short texts."""
    length = F.col(length) if isinstance(length, str) else length
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.when(length < SHORT_TEXT, t).otherwise(F.exp(F.lit(1.0) / length) * t)


def nearest_language(distances: Column | str, margin: Column | float) -> Column:
    """Pick from ``ARRAY<STRUCT<language, distance>>``, candidates in order.

    With English among the candidates, English wins whenever it is within the
    margin of the nearest, and equal distances go to the first in order.
    Without it, equal nearest candidates leave the text unknown.
    """
    near = F.col(distances) if isinstance(distances, str) else distances
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))
    least = F.array_min(F.transform(near, lambda x: x["distance"]))
    nearest = F.filter(near, lambda x: x["distance"] == least)
    english = F.get(F.filter(near, lambda x: x["language"] == ENGLISH), F.lit(0))["distance"]
    close = F.coalesce(F.try_divide(english - least, least) < margin, F.lit(False))
    return (
        F.when(F.coalesce(F.size(near), F.lit(0)) <= 0, UNKNOWN)
        .when(english.isNotNull() & ((english == least) | close), ENGLISH)
        .when(english.isNotNull() | (F.size(nearest) == 1), F.get(nearest, F.lit(0))["language"])
        .otherwise(UNKNOWN)
    )
