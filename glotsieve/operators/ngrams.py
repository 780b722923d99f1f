"""Character n-gram ranks, language templates and rank distances."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotsieve.functions import text as tx
from glotsieve.session import settle
from glotsieve.values import CANDIDATES, GRAM_SIZE, TEMPLATE_SIZE

# Tasks get the helpers below along with the functions that use them, so that
# workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = 1 << 18  # grams a task gathers before it hands them over


def count_grams(counts: Counter[str], text: str | None, n: int) -> None:
    """Add the overlapping n-grams of a text, by code points."""
    if text:
        counts.update([text[i : i + n] for i in range(len(text) - n + 1)])


def falling(counts: Counter[str]) -> list[str]:
    """Grams by falling count, equal ones by gram: the second sort keeps the order of equals."""
    return sorted(sorted(counts), key=counts.__getitem__, reverse=True)


def _ranked_texts(by: int, n: int):
    """Grams of one group after the other, in pieces of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names[:by], "gram", "n", "rank"]

            def rows() -> pa.RecordBatch:
                which = pa.array(np.repeat(owners, sizes))
                ranks = np.concatenate([np.arange(1, size + 1, dtype=np.int32) for size in sizes])
                keys = [c.take(which) for c in batch.columns[:by]]
                return pa.record_batch(
                    [*keys, pa.array(grams, pa.string()), pa.array(ns, pa.int64()), pa.array(ranks)], names
                )

            owners, sizes, grams, ns = [], [], [], []
            for i, texts in enumerate(batch.column(by)):
                counts: Counter[str] = Counter()
                for text in texts.as_py():
                    count_grams(counts, text, n)
                order = falling(counts)
                owners.append(i)
                sizes.append(len(order))
                grams += order
                ns += [counts[g] for g in order]
                if len(grams) > HELD:
                    yield rows()
                    owners, sizes, grams, ns = [], [], [], []
            if grams:
                yield rows()

    return run


def char_ngrams(
    df: DataFrame,
    by: list[str],
    text: str = "text",
    n: int = GRAM_SIZE,
    limit: int | None = TEMPLATE_SIZE,
) -> DataFrame:
    """``(*by, gram, n, rank)``: n-grams of a group by falling frequency.

    Equal counts are ordered by gram. Counts are combined within tasks, and
    with a limit each task first drops what cannot rank, so a class that holds
    a third of the corpus still sends a few hundred grams a task to its window.
    Without one, groups are texts: they move once, and a task counts, ranks and
    hands over the grams of one after the other.
    """
    texts = df.select(*by, F.col(text).alias("_text"))
    if limit is None:
        grouped = texts.repartition(*by).groupBy(*by).agg(F.collect_list("_text").alias("_texts"))
        kinds = texts.select(*by, F.lit("").alias("gram"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("rank"))
        return grouped.mapInArrow(_ranked_texts(len(by), n), kinds.schema)
    counts = (
        texts.select(*by, F.explode(tx.char_ngrams("_text", n)).alias("gram"))
        .groupBy(*by, "gram")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


@dataclass(frozen=True)
class Templates:
    """``(language, gram, rank)``, settled, and how many grams each language has."""

    table: DataFrame
    sizes: Mapping[str, int]
    n: int = GRAM_SIZE
    k: int = TEMPLATE_SIZE


def train_ngrams(
    df: DataFrame,
    language: str = "language",
    text: str = "text",
    n: int = GRAM_SIZE,
    k: int = TEMPLATE_SIZE,
) -> Templates:
    grams = char_ngrams(df, [language], text, n, k)
    table = grams.select(F.col(language).alias("language"), "gram", "rank")
    return templates_of(settle(table, "templates"), n, k)


def templates_of(table: DataFrame, n: int = GRAM_SIZE, k: int = TEMPLATE_SIZE) -> Templates:
    """Wrap a template table; the sizes are one number a language."""
    sizes = table.groupBy("language").agg(F.count("*").alias("n")).orderBy("language")
    return Templates(table, {r.language: r.n for r in sizes.collect()}, n, k)


def candidates_with_template(
    templates: Templates, groups: Mapping[str, list[str]] = CANDIDATES
) -> dict[str, list[str]]:
    """Candidates of each script group, in order, that have a template."""
    return {g: [c for c in names if c in templates.sizes] for g, names in groups.items()}


def candidate_languages(df: DataFrame, script: str = "script") -> DataFrame:
    """Add ``candidates``: the languages a script group may stand for, in order."""
    column = F.lit(None).cast("array<string>")
    for group, names in CANDIDATES.items():
        column = F.when(
            F.col(script) == group, F.array(*[F.lit(x) for x in names])
        ).otherwise(column)
    return df.withColumn("candidates", column)


def text_distances(
    texts: Iterable[str | None], ranks: Mapping[str, list[tuple[int, int]]], sizes: list[int], n: int, k: int
) -> tuple[list[int], bool]:
    """Rank distances of some texts, taken as one, to the templates of their group.

    ``ranks`` holds ``(place, rank)`` of a gram by candidate, and ``sizes`` how
    many grams each has. A gram the texts lack costs k: rather than listing the
    missing ones, each match lowers k times the template's size. The second
    value tells whether the texts have any gram.
    """
    counts: Counter[str] = Counter()
    for text in texts:
        count_grams(counts, text, n)
    found = [k * size for size in sizes]
    for rank, gram in enumerate(falling(counts), 1):
        for place, expected in ranks.get(gram, ()):
            found[place] += abs(rank - expected) - k
    return found, bool(counts)


def rank_distances(
    df: DataFrame,
    by: list[str],
    script: str,
    text: Column,
    templates: Templates,
    groups: Mapping[str, list[str]] = CANDIDATES,
    bare: bool = False,
) -> DataFrame:
    """``(*by, distances)`` with ``ARRAY<STRUCT<language, distance>>``.

    ``by`` identifies a text, by its key first, and includes its ``script``
    group. The grams of a text stay in its row: they are counted, ranked and
    matched with the templates there, which are broadcast (at most k rows a
    candidate), so a task holds one text's grams at a time, whatever the
    partition. A text that is null keeps its row; one without any grams has null
    distances, or with ``bare`` those of a text that lacks every gram.
    """
    usable = {g: names for g, names in candidates_with_template(templates, groups).items() if names}
    places: dict[str, list[tuple[str, int]]] = {}
    for group, names in usable.items():
        for place, language in enumerate(names):
            places.setdefault(language, []).append((group, place))
    ranks: dict[str, dict[str, list[tuple[int, int]]]] = {g: {} for g in usable}
    # At most k rows a candidate.
    for row in templates.table.filter(F.col("language").isin(list(places))).collect():
        for group, place in places[row.language]:
            ranks[group].setdefault(row.gram, []).append((place, row.rank))
    sizes = {g: [templates.sizes[language] for language in names] for g, names in usable.items()}
    shared = df.sparkSession.sparkContext.broadcast((ranks, sizes))
    n, k = templates.n, templates.k

    @F.arrow_udf("array<bigint>")
    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ranks, sizes = shared.value
        for texts, scripts in batches:
            found = []
            for given, group in zip(texts, scripts.to_pylist()):
                if group not in sizes:
                    found.append(None)
                    continue
                distances, some = text_distances(given.as_py(), ranks[group], sizes[group], n, k)
                found.append(distances if some or bare else None)
            yield pa.array(found, pa.list_(pa.int64()))

    texts = df.select(*by, text.alias("_text")).groupBy(*by).agg(F.collect_list("_text").alias("_texts"))
    measured = texts.select(*by, measure("_texts", F.col(script)).alias("_found"))
    distances = F.lit(None).cast("array<struct<language:string,distance:bigint>>")
    for group, names in usable.items():
        row = [
            F.struct(F.lit(language).alias("language"), F.get("_found", F.lit(i)).alias("distance"))
            for i, language in enumerate(names)
        ]
        wanted = (F.col(script) == group) & F.col("_found").isNotNull()
        distances = F.when(wanted, F.array(*row)).otherwise(distances)
    return measured.select(*by, distances.alias("distances"))


def ngram_distance(
    df: DataFrame, key: str, text: str, templates: Templates, languages: list[str] | None = None
) -> DataFrame:
    """``(key, language, distance)`` from every text to every template.

    A text shorter than one gram lacks all of a template's. Texts are
    exchanged once, by key, and their grams not at all.
    """
    names = languages or sorted(templates.sizes)
    keyed = df.select(key, text, F.lit("any").alias("script")).repartition(key)
    found = rank_distances(
        keyed, [key, "script"], "script", F.col(text), templates,
        {"any": names}, bare=True,
    )
    return found.select(key, F.inline("distances"))
