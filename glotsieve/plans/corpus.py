"""Building a labelled corpus out of several sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotsieve.operators.dataset import (
    add_source,
    dedup_rows,
    drop_column,
    filter_languages,
    filter_removed,
    standardise_columns,
    union_sources,
)
from glotsieve.operators.labels import (
    iso639_1_to_language,
    iso639_3_to_language,
    replace_language,
)
from glotsieve.operators.sampling import flag_sampled, split_train_test
from glotsieve.session import attach
from glotsieve.values import LANGUAGES


@dataclass(frozen=True)
class Source:
    """One table of labelled texts; ``labels`` is name, iso639-1 or iso639-3."""

    name: str
    rows: DataFrame
    text: str = "text"
    language: str = "language"
    labels: str = "name"


def read_source(source: Source, key: str) -> DataFrame:
    """``(key, text, language)`` with standard labels."""
    rows = standardise_columns(source.rows, source.text, source.language, key)
    if source.labels == "iso639-1":
        rows = iso639_1_to_language(rows, "language", key)
    elif source.labels == "iso639-3":
        codes = [code3 for _, _, _, code3, _, _ in LANGUAGES]
        rows = iso639_3_to_language(filter_languages(rows, codes), "language", key)
    return rows.withColumn("language", replace_language("language"))


def build_dataset(
    sources: list[Source],
    sampled: Source,
    quotas: DataFrame | None,
    key: str,
    corrections: DataFrame | None = None,
    strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The corpus and the unseen rows of the sampled source.

    Every source is split on its own, then labels are corrected by key
    (``key, corrected``), struck-out rows and repeated rows leave, and a
    stratified sample of the large source is added. Without ``quotas`` it holds
    the usual number of rows of each of the 32 languages.
    """
    if quotas is None:
        usual = [(label, n) for label, *_, n in LANGUAGES]
        quotas = sampled.rows.sparkSession.createDataFrame(usual, "language STRING, quota INT")
    parts = [
        split_train_test(add_source(read_source(s, key), s.name), key) for s in sources
    ]
    combined = union_sources(*parts).withColumn("original_language", F.col("language"))
    if corrections is not None:
        fixed = attach(combined, corrections.select(key, "corrected"), key, spread_by=key)
        combined = fixed.withColumn(
            "language", F.coalesce("corrected", "language")
        ).drop("corrected")
    reviewed = drop_column(dedup_rows(filter_removed(combined), key), "original_language")
    flagged = flag_sampled(read_source(sampled, key), key, quotas, strict=strict)
    chosen = add_source(flagged.filter("sampled").drop("sampled"), sampled.name)
    corpus = union_sources(reviewed, split_train_test(chosen, key))
    return corpus, flagged.filter(~F.col("sampled"))
