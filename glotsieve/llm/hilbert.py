"""Sharding along a Hilbert curve over quantised metadata.

Several metadata columns are cut into 2**bits classes of about equal size
each. The classes of a row are a point of a grid; rows are ordered by the
place of their point on the Hilbert curve and the order is cut into runs. A
run is a connected piece of the grid, so it spans few classes of every column
and a filter on any of them prunes most shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotsieve.session import settle

SHARDS = 16
BITS = 5
ACCURACY = 10_000  # of the class borders, see percentile_approx


def curve_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of ``points``, unsigned of ``bits`` each.

    By Skilling's transform: from the highest bit down, coordinates are
    exchanged or inverted as their bits say, then Gray-coded and interleaved.
    """
    x = points.astype(np.uint64).copy()
    n = x.shape[1]
    if n * bits > 63:
        raise ValueError(f"{n} columns of {bits} bits do not fit 63 bits")
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(n):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        flip ^= np.where((x[:, n - 1] & bit) != 0, bit - np.uint64(1), np.uint64(0))
    x ^= flip[:, None]
    index = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << np.uint64(1)) | ((x[:, i] >> np.uint64(level)) & np.uint64(1))
    return index.astype(np.int64)


def curve(classes: list[Column], bits: int) -> Column:
    n = len(classes)

    @F.arrow_udf("bigint")
    def place(points: pa.Array) -> pa.Array:
        flat = points.flatten().to_numpy(zero_copy_only=False)
        return pa.array(curve_index(flat.reshape(len(points), n), bits))

    return place(F.array(*classes))


def string_borders(df: DataFrame, name: str, shares: list[float]) -> list[str]:
    """Whole values of a string column at the given shares of all rows, nulls first.

    Values are counted, dealt by ranges and summed within each, so the borders
    are exact, a value that fills a third of the table is one row, and values of
    a long common beginning are told apart. One number a range and one value a
    share come to the driver. Where a share falls among nulls the border is the
    empty string, which all values reach.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(tasks, F.col("value").asc_nulls_first())
    ranged = settle(ranged.withColumn("task", F.spark_partition_id()), "shard-values")
    total, starts = 0, []
    for task, n in sorted(tuple(r) for r in ranged.groupBy("task").agg(F.sum("n")).collect()):
        starts.append((task, total))
        total += n
    if not total:
        return []
    places = F.array(*[F.lit(int(s * total)) for s in shares])
    starts = df.sparkSession.createDataFrame(starts, "task int, start bigint")
    within = Window.partitionBy("task").orderBy(F.col("value").asc_nulls_first())
    placed = ranged.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(starts), "task")
    placed = placed.select(
        F.coalesce("value", F.lit("")).alias("value"),
        F.filter(places, lambda p: p.between(F.col("start") + F.col("upto") - F.col("n"), F.col("start") + F.col("upto") - 1)).alias("p"),
    )
    # a place that several shares fall on is a border of each
    return [r.value for r in placed.select("value", F.explode("p").alias("p")).orderBy("p").collect()]


def quantise(df: DataFrame, names: list[str], bits: int) -> list[Column]:
    """Class of every column: how many of its borders lie below. All rows decide on the borders. Null is first."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    strings = [n for n in names if df.schema[n].dataType.typeName() == "string"]
    columns, borders = {n: F.col(n) for n in strings}, {n: string_borders(df, n, shares) for n in strings}
    for n in set(names) - set(strings):
        number = F.col(n).cast("double")
        columns[n] = F.when(number.isNull() | F.isnan(number), float("-inf")).otherwise(number)
    numbers = [n for n in names if n not in strings]
    if numbers:
        found = df.agg(*[F.percentile_approx(columns[n], shares, ACCURACY) for n in numbers]).first()
        borders.update(zip(numbers, found))
    classes = []
    for n in names:
        # borders of many equal values fall together: such a value takes their whole range of
        # numbers, so a column of few values still reaches the high bits of the curve
        class_of = F.lit(0)
        for k, border in enumerate(borders[n] or []):
            class_of = F.when(columns[n] >= F.lit(border), k + 1).otherwise(class_of)
        classes.append(class_of.cast("bigint"))
    return classes


def hilbert_shards(
    docs: DataFrame,
    dimensions: tuple[str, ...] = ("source", "lang", "_size"),
    shards: int = SHARDS,
    bits: int = BITS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, size, text_crc32, curve, shard, slot): every row in one of ``shards`` runs of the curve.

    Row counts of shards differ by one at most; ``slot`` numbers the rows of a
    shard from 0 in curve order. ``_size`` among the dimensions stands for the
    bytes of the text plus 1 (null: 1); any other is a column of ``docs``. Null
    and missing values come first; without rows, or with fewer than ``shards``,
    the last shards are empty. Equal points are in the order of a hash of the
    key, then of key, size and checksum; rows equal in these are alike.

    Only keys, sizes and classes move, once, by ranges of (curve, hash), so a
    point that holds a third of all rows is spread over as many tasks as it
    needs. Positions are counted by range, not by a window over all rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    columns = [d for d in dimensions if d != "_size"]
    rows = docs.select(
        F.col(key).alias("_key"),
        size.alias("_size"),
        F.crc32(F.col(text).cast("binary")).alias("_crc"),
        *[F.col(c).alias(f"_d_{c}") for c in columns],
    )
    rows = settle(rows, "shard-rows")
    names = ["_size" if d == "_size" else f"_d_{d}" for d in dimensions]
    placed = rows.select(
        "_key", "_size", "_crc", curve(quantise(rows, names, bits), bits).alias("_curve"),
        F.xxhash64("_key").alias("_hash"),
    )
    order = ["_curve", "_hash", "_key", "_size", "_crc"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_id", F.monotonically_increasing_id())
    ranged = settle(ranged.select("_key", "_size", "_crc", "_curve", "_id"), "shard-order")
    task = F.shiftrightunsigned("_id", 33)
    # a row for each range; the ranges are as many as the shuffle has partitions
    counts = ranged.groupBy(task.alias("_task")).count().collect()
    total, starts = 0, []
    for row in sorted(counts):
        starts.append((row[0], total))
        total += row[1]
    starts = docs.sparkSession.createDataFrame(starts, "_task bigint, _start bigint")
    base, more = divmod(total, shards)
    edge = more * (base + 1)
    rank = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    out = ranged.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn("_rank", rank)
    early = F.floor(F.col("_rank") / F.lit(base + 1))
    late = F.lit(more) + F.floor((F.col("_rank") - edge) / F.lit(max(base, 1)))
    shard = F.when(F.col("_rank") < edge, early).otherwise(late).cast("int")
    start = F.col("_shard") * base + F.least(F.col("_shard"), F.lit(more))
    return out.withColumn("_shard", shard).select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_curve").alias("curve"),
        F.col("_shard").alias("shard"),
        (F.col("_rank") - start).cast("bigint").alias("slot"),
    )


def write_shards(
    docs: DataFrame, path: str, dimensions: tuple[str, ...] = ("source", "lang", "_size"), shards: int = SHARDS,
    bits: int = BITS, text: str = "text", files: int | None = None,
) -> None:
    """Write all rows and columns of ``docs`` as Parquet files by shard, in slot order, with the ranges of each file.

    Rows are told apart by a settled number, so keys may repeat or be missing;
    every row is in the shard that `hilbert_shards` gives it. A file holds
    consecutive slots of one shard, and ``files`` (as many as the shuffle has
    partitions, by default) says about how many there are. ``path/rows`` has the
    rows with ``_shard`` and ``_slot``; ``path/ranges`` has for each file the
    smallest and the largest whole value of every dimension, and whether it
    holds a missing one. Columns of ``docs`` named ``_shard``, ``_slot`` or
    ``_row`` are refused.
    """
    clash = {"_shard", "_slot", "_row"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns of these names are needed: {sorted(clash)}")
    spark = docs.sparkSession
    rows = settle(docs.withColumn("_row", F.monotonically_increasing_id()), "rows-to-shard")
    placed = hilbert_shards(rows, dimensions, shards, bits, "_row", text)
    placed = placed.select("_row", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = rows.join(placed, "_row").drop("_row")
    files = files or max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ranges of (shard, slot): a shard of many rows is several files, none is one task's alone
    out = out.repartitionByRange(files, "_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    out.write.partitionBy("_shard").parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").withColumn("file", F.input_file_name())
    found = [F.count("*").alias("rows")]
    for d in dimensions:
        value = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1 if d == "_size" else F.col(d)
        found += [F.min(value).alias(f"low_{d}"), F.max(value).alias(f"high_{d}"), F.bool_or(value.isNull()).alias(f"missing_{d}")]
    held.groupBy("file").agg(*found).coalesce(1).write.parquet(f"{path}/ranges")


def read_shards(spark, path: str, **wanted) -> tuple[DataFrame, int, int]:
    """Rows written by `write_shards` from the files that may hold wanted values, with the files read and those skipped.

    ``wanted`` has for a dimension a pair (least, most), or None for missing
    values; rows are filtered too. Only names of files come to the driver.
    """
    ranges, row = spark.read.parquet(f"{path}/ranges"), F.lit(True)
    keep = F.lit(True)
    for d, pair in wanted.items():
        value = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1 if d == "_size" else F.col(d)
        if pair is None:
            keep, row = keep & F.col(f"missing_{d}"), row & value.isNull()
        else:
            keep = keep & (F.col(f"low_{d}") <= pair[1]) & (F.col(f"high_{d}") >= pair[0])
            row = row & value.between(*pair)
    files = [r.file for r in ranges.filter(keep).select("file").collect()]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*files) if files else spark.read.parquet(f"{path}/rows").limit(0)
    return rows.filter(row), len(files), ranges.count() - len(files)
