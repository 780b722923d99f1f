"""Reading and writing labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glotsieve.session import settle

LABELLED = "text STRING, language STRING"


def scan_texts(
    spark: SparkSession,
    path: str | list[str],
    format: str = "parquet",
    schema: str | StructType | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Read a text table; CSV takes a declared schema, so files are read once.

    CSV fields may hold line breaks, and then a file is one task. Turn
    ``multiline`` off for large files whose fields hold none.
    """
    if format == "csv":
        reader = spark.read.schema(schema or LABELLED)
        return reader.csv(path, header=True, multiLine=multiline, quote='"', escape='"')
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(path)


def add_key(df: DataFrame, key: str) -> DataFrame:
    """Number the rows of a table that has no unique column.

    The numbers depend on how rows lie in partitions, so the table is written
    with them: a task that runs again must not number its rows anew. Detection
    needs no key; use this only where rows must be told apart.
    """
    return settle(df.withColumn(key, F.monotonically_increasing_id()), "keyed")


def write_dataset(df: DataFrame, path: str) -> None:
    """Write a labelled corpus, one folder a split.

    Rows go to files as their tasks hold them: moving them by split would send
    four fifths of the corpus to one task.
    """
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def write_unseen(flagged: DataFrame, path: str, flag: str = "sampled") -> None:
    """Write the rows of a source that a flag says were not sampled."""
    flagged.filter(~F.coalesce(F.col(flag), F.lit(False))).drop(flag).write.parquet(path)


def write_corpus(df: DataFrame, path: str, split: str = "train") -> None:
    """Write the texts of one split, one a line, without header."""
    df.filter(F.col("split") == split).select("text").write.text(path)
