"""Unicode block tables.

A table has ``block_start, block_end, block``. It is read from a Unicode
``Blocks`` file, or derived from the Unicode data of the JVM that runs Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glotsieve.values import BLOCK_TARGETS

BLOCK_WIDTH = 16  # every block starts and ends on a multiple of 16
CODE_POINTS = 0x110000
_LINE = r"^([0-9A-Fa-f]{4,6})\.\.([0-9A-Fa-f]{4,6});\s*(.*\S)\s*$"


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Parse lines ``start..end; name``; comments and blank lines are skipped."""

    def code(group: int) -> Column:
        return F.conv(F.regexp_extract("value", _LINE, group), 16, 10).cast("int")

    return (
        spark.read.text(path)
        .filter(F.col("value").rlike(_LINE))
        .select(
            code(1).alias("block_start"),
            code(2).alias("block_end"),
            F.regexp_extract("value", _LINE, 3).alias("block"),
        )
    )


def jvm_blocks(spark: SparkSession) -> DataFrame:
    """The block table of the running JVM.

    It spells names in capitals with underscores. Unicode says that case,
    spaces, hyphens and underscores do not count in block names, so names the
    classifier knows get their usual spelling back; others are written with
    spaces.
    """
    app = spark.sparkContext.applicationId
    if app not in _BLOCKS:
        _BLOCKS[app] = [tuple(row) for row in _derive_blocks(spark).collect()]
    return spark.createDataFrame(_BLOCKS[app], "block_start INT, block_end INT, block STRING")


# Some 300 rows, whatever the data; derived once a session.
_BLOCKS: dict[str, list[tuple]] = {}


def _derive_blocks(spark: SparkSession) -> DataFrame:
    known = {_loose(name): name for name in BLOCK_TARGETS}
    known["GREEK"] = "Greek and Coptic"  # the one block the JVM names otherwise
    spelling = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    name = F.expr("reflect('java.lang.Character$UnicodeBlock', 'of', cast(id as int))")
    readable = F.initcap(F.replace(F.col("name"), F.lit("_"), F.lit(" ")))
    return (
        spark.range(0, CODE_POINTS, BLOCK_WIDTH)
        .select("id", name.alias("name"))
        .filter(F.col("name") != "null")
        .groupBy("name")
        .agg(
            F.min("id").cast("int").alias("block_start"),
            (F.max("id") + BLOCK_WIDTH - 1).cast("int").alias("block_end"),
        )
        .select(
            "block_start",
            "block_end",
            F.coalesce(
                F.try_element_at(spelling, F.regexp_replace("name", "_", "")), readable
            ).alias("block"),
        )
        .orderBy("block_start")
    )


def _loose(name: str) -> str:
    return "".join(c for c in name.upper() if c not in " -_")


def block_slots(blocks: DataFrame) -> DataFrame:
    """One row for each 16 code points of a block.

    A code point then finds its block by an equi-join on ``slot``, with no
    range join. At most 69,632 rows, whatever the data.
    """
    return blocks.select(
        F.explode(
            F.sequence(
                F.shiftright("block_start", 4), F.shiftright("block_end", 4)
            )
        ).alias("slot"),
        "block_start",
    )
