"""Standard language labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glotsieve.session import attach
from glotsieve.values import LABEL_ALIASES, LANGUAGES, UNKNOWN_CODE


def iso_names(spark: SparkSession) -> DataFrame:
    """ISO 639 codes of either length and their names: some hundred rows.

    The languages of the classifier have their ISO names. Every other code the
    JVM's language data knows, all of 639-1 among them, has the English name
    given there.
    """
    app = spark.sparkContext.applicationId
    if app not in _NAMES:
        names = _jvm_names(spark)
        names.update((code1, name1) for _, code1, name1, *_ in LANGUAGES)
        names.update((code3, name3) for _, _, _, code3, name3, _ in LANGUAGES)
        _NAMES[app] = sorted(names.items())
    return spark.createDataFrame(_NAMES[app], "code STRING, iso_name STRING")


_NAMES: dict[str, list[tuple[str, str]]] = {}


def _jvm_names(spark: SparkSession) -> dict[str, str]:
    locale = spark._jvm.java.util.Locale
    english = locale.ENGLISH
    known = {str(x) for x in locale.getISOLanguages()}
    known |= {str(x.getLanguage()) for x in locale.getAvailableLocales()} - {""}
    names = {}
    for code in sorted(known):
        language = locale.forLanguageTag(code)
        name = str(language.getDisplayLanguage(english))
        if name and name != code:
            names[code] = name
            if len(code) == 2:
                names[str(language.getISO3Language())] = name
    return names


def code_to_language(
    df: DataFrame, column: str, key: str, names: DataFrame | None = None
) -> DataFrame:
    """Replace a code by its ISO name; codes without one become ``unknown``.

    ``names`` may bring a fuller code table (``code, iso_name``).
    """
    names = names if names is not None else iso_names(df.sparkSession)
    named = attach(
        df, names.withColumnRenamed("code", column), column, spread_by=key, how="left"
    )
    return named.select(
        *[
            F.coalesce("iso_name", F.lit(UNKNOWN_CODE)).alias(c) if c == column else F.col(c)
            for c in df.columns
        ]
    )


def _by_code_length(df: DataFrame, column: str, key: str, length: int, names) -> DataFrame:
    names = names if names is not None else iso_names(df.sparkSession)
    return code_to_language(df, column, key, names.filter(F.length("code") == length))


def iso639_1_to_language(df, column: str, key: str, names: DataFrame | None = None):
    return _by_code_length(df, column, key, 2, names)


def iso639_3_to_language(df, column: str, key: str, names: DataFrame | None = None):
    return _by_code_length(df, column, key, 3, names)


def replace_language(language: Column | str, aliases: Mapping[str, str] = LABEL_ALIASES) -> Column:
    """Exact substitution of label spellings; other labels stay."""
    column = F.col(language) if isinstance(language, str) else language
    replaced = column
    for spelling, label in aliases.items():
        replaced = F.when(column == spelling, F.lit(label)).otherwise(replaced)
    return replaced


def drop_rarest_language(df: DataFrame, column: str = "language") -> DataFrame:
    """Drop the one class with the fewest rows; of equals, the first by name.

    A missing label is no class: its rows do not count, and stay.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # A global aggregate, so exactly one row is broadcast.
    rarest = counts.agg(F.min_by(column, F.struct("n", column)).alias(column))
    return df.join(F.broadcast(rarest), column, "left_anti")
