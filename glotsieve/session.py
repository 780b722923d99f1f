"""Sessions, shared scratch space and the size-checked join helper."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
PART = 4 << 20  # characters of text in a partition whose tokens are grouped there


def build_session(master: str | None = None, name: str = "glotsieve", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for setting, value in settings.items():
        builder = builder.config(setting, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. Frames that read it are of no use then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table once to shared storage and read it back.

    It is used for results that several later steps read, such as counts of a
    model: losing an executor then costs a re-read, not a second pass over
    the corpus, and the size of the table is known from its files. ``by``
    names a column of few values to keep apart, so that filters on it skip
    files.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame, key: str, text: str) -> DataFrame:
    """Move texts by key, into partitions of a bounded size, which costs a pass to add up lengths.

    Partitions that Spark merges by the size of the texts are too large where
    each text is taken apart and grouped by key: its tokens take many times that.
    """
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / PART))
    return df.repartition(parts, key)


def attach(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    spread_by: str,
    how: str = "left",
    max_rows: int = 500_000,
    salts: int = 32,
    rows: int | None = None,
) -> DataFrame:
    """Equi-join a lookup table whose size is checked first.

    ``rows`` is an upper bound of its rows, if the caller knows one; else they
    are counted, so ``small`` should be settled. Up to ``max_rows`` rows it is
    broadcast. Beyond, ``big`` is spread by its unique
    column ``spread_by`` over ``salts`` copies of each lookup row, so that one
    hot key does not end up in one task.
    """
    if rows is None:
        rows = small.limit(max_rows + 1).count()
    if rows <= max_rows:
        return big.join(F.broadcast(small), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    salted = big.withColumn("_salt", F.pmod(F.hash(spread_by), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
