"""Which Unicode blocks a text's letters fall in, and what that says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotsieve.functions.text import letter_runs
from glotsieve.sources.blocks import block_slots
from glotsieve.values import (
    BLOCK_SHARE,
    BLOCK_TARGETS,
    DISTINCTIVE_LETTERS,
    HANGUL_BLOCKS,
    KANA_BLOCKS,
    UNKNOWN,
)

NO_BLOCK = -1


def _letters_by_block(
    df: DataFrame, by: list[str], runs: Column, blocks: DataFrame
) -> DataFrame:
    """``(*by, block_start, n, first_pos)``: letters a text has in each block.

    A text without letters keeps one row, with a null block. Letters are
    summed within their task, so a text leaves it as one row a block. The
    slot table has a fixed size and is broadcast.
    """
    letters = df.select(*by, F.posexplode_outer(runs).alias("pos", "run"))
    slotted = letters.withColumn("slot", F.shiftright(F.ascii("run"), 4))
    start = F.when(
        F.col("run").isNotNull(), F.coalesce("block_start", F.lit(NO_BLOCK))
    )
    return (
        slotted.join(F.broadcast(block_slots(blocks)), "slot", "left")
        .groupBy(*by, start.alias("block_start"))
        .agg(F.sum(F.length("run")).alias("n"), F.min("pos").alias("first_pos"))
    )


def count_blocks(
    df: DataFrame, key: str, text: str, blocks: DataFrame, keep: bool = False
) -> DataFrame:
    """``(key, block, n, share, first_pos)``: one row for each block of a text.

    A text without letters has no row, or with ``keep`` one without a block,
    from which ``highest_block`` and ``cjk_rule`` make a row for every text.
    Texts are exchanged once, by key, and their letters not at all.
    ``first_pos`` orders blocks by their first letter in the text. The text
    should be cleaned, or composed by ``nfc`` if it holds combining marks.
    """
    texts = df.select(key, F.col(text).alias("_text")).repartition(key)
    counted = _letters_by_block(texts, [key], letter_runs("_text"), blocks)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    found = F.col("block_start").isNotNull()
    return (
        (counted if keep else counted.filter(found))
        .join(F.broadcast(blocks), "block_start", "left")
        .select(
            key,
            F.when(found, F.coalesce("block", F.lit("No Block"))).alias("block"),
            "n",
            share.alias("share"),
            "first_pos",
        )
    )


def highest_block(profile: DataFrame, key: str) -> DataFrame:
    """``(key, top_block, top_share)``: the block of the largest share.

    Equal shares go to the block seen first in the text; below 30 %, and for a
    text without letters, the block is ``UNKNOWN``.
    """
    top = profile.groupBy(key).agg(
        F.max_by("block", F.struct("n", -F.col("first_pos"))).alias("block"),
        F.max("share").alias("top_share"),
    )
    enough = F.col("top_share") >= BLOCK_SHARE
    return top.select(
        key, F.when(enough, F.col("block")).otherwise(UNKNOWN).alias("top_block"), "top_share"
    )


def script_of_block(block: Column | str) -> Column:
    """Language or script group of a block; ``UNKNOWN`` for any other block."""
    block = F.col(block) if isinstance(block, str) else block
    targets = F.create_map(*[F.lit(x) for pair in BLOCK_TARGETS.items() for x in pair])
    return F.coalesce(F.try_element_at(targets, block), F.lit(UNKNOWN))


def cjk_language(has_kana: Column, has_hangul: Column) -> Column:
    return F.when(has_kana, "Japanese").when(has_hangul, "Korean").otherwise("Chinese")


def cjk_rule(profile: DataFrame, key: str) -> DataFrame:
    """``(key, cjk_language)``: kana means Japanese, else Hangul Korean, else Chinese."""
    seen = profile.groupBy(key).agg(
        F.bool_or(F.col("block").isin(KANA_BLOCKS)).alias("kana"),
        F.bool_or(F.col("block").isin(HANGUL_BLOCKS)).alias("hangul"),
    )
    return seen.select(key, cjk_language(F.col("kana"), F.col("hangul")).alias("cjk_language"))


def unique_chars(text: Column | str, script: Column | str) -> Column:
    """Language whose distinctive letter occurs in the text, or null.

    Row-local; the letters of a group are tried in a fixed order.
    """
    text = F.col(text) if isinstance(text, str) else text
    script = F.col(script) if isinstance(script, str) else script

    def first_match(group: str) -> Column:
        found = F.lit(None).cast("string")
        for language, letters in reversed(DISTINCTIVE_LETTERS[group]):
            found = F.when(text.rlike(f"[{letters}]"), F.lit(language)).otherwise(found)
        return found

    return (
        F.when(script == "CYRILLIC", first_match("CYRILLIC"))
        .when(script == "ARABIC", first_match("ARABIC"))
        .when(script.isin("BASIC LATIN", "EXTENDED LATIN"), first_match("LATIN"))
    )


def top_blocks(
    df: DataFrame, by: list[str], runs: Column, blocks: DataFrame
) -> DataFrame:
    """``(*by, top_block, has_kana, has_hangul)`` in one aggregation pass.

    Blocks are numbers until the end, which keeps the aggregation on
    fixed-width buffers. Count and position share one long: the larger count
    wins, then the earlier position.
    """
    names = F.broadcast(blocks.select("block_start", "block"))
    position = F.lit(2**31 - 1) - F.col("first_pos")
    rank = F.col("n") * F.lit(2**31) + position
    counted = _letters_by_block(df, by, runs, blocks).join(names, "block_start", "left")
    top = counted.groupBy(*by).agg(
        F.max_by("block_start", rank).alias("block_start"),
        (F.max("n") / F.sum("n")).alias("top_share"),
        F.bool_or(F.col("block").isin(KANA_BLOCKS)).alias("has_kana"),
        F.bool_or(F.col("block").isin(HANGUL_BLOCKS)).alias("has_hangul"),
    )
    enough = F.col("top_share") >= BLOCK_SHARE
    return top.join(names, "block_start", "left").select(
        *by,
        F.when(enough, F.coalesce("block", F.lit("No Block"))).otherwise(UNKNOWN).alias("top_block"),
        "has_kana",
        "has_hangul",
    )
