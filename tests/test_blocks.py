import pytest

from glotsieve.operators import blocks as bl
from glotsieve.sources import blocks as sb
from glotsieve.values import BLOCK_TARGETS, DISTINCTIVE_LETTERS
from pyspark.sql import functions as F


def _texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "key LONG, text STRING")


def _tops(spark, blocks, values):
    profile = bl.count_blocks(_texts(spark, values), "key", "text", blocks)
    tops = {r.key: r.top_block for r in bl.highest_block(profile, "key").collect()}
    return [tops.get(i) for i in range(len(values))]


def test_block_file(spark, tmp_path):
    path = tmp_path / "blocks.txt"
    path.write_text("# comment\n\n0000..007F; Basic Latin\n10400..1044F; Deseret\n")
    rows = sb.load_blocks(spark, str(path)).orderBy("block_start").collect()
    assert [tuple(r) for r in rows] == [
        (0, 0x7F, "Basic Latin"), (0x10400, 0x1044F, "Deseret"),
    ]


def test_jvm_table_knows_every_mapped_block(blocks):
    rows = {r.block: (r.block_start, r.block_end) for r in blocks.collect()}
    assert set(BLOCK_TARGETS) <= set(rows)
    assert rows["Greek and Coptic"] == (0x370, 0x3FF)
    assert rows["CJK Unified Ideographs"] == (0x4E00, 0x9FFF)
    assert sb.block_slots(blocks).count() < 70_000


def test_top_block_edges(spark, blocks):
    values = [
        "aaaжжжжжжж"[:10],  # most are Cyrillic
        "ab жз",  # a tie goes to the first seen
        "жз ab",
        "ÿÿ a",  # the last letter of a block
        "\U00010400\U00010401",  # beyond U+FFFF
        "abc жжж γγγ שׁ"[:11] + "אאא",  # no exact thirds needed
        "aaa жжж γγγ אאא",  # all below 30 %
        "aaa жж γγ אא ا",  # exactly 30 %
    ]
    assert _tops(spark, blocks, values) == [
        "Cyrillic", "Basic Latin", "Cyrillic", "Latin-1 Supplement", "Deseret",
        "UNKNOWN", "UNKNOWN", "Basic Latin",
    ]


def test_both_ways_to_the_top_block_agree(spark, blocks, docs):
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    direct = bl.top_blocks(texts, ["key"], bl.letter_runs("text"), blocks)
    profile = bl.highest_block(bl.count_blocks(texts, "key", "text", blocks), "key")
    joined = direct.join(profile.select("key", F.col("top_block").alias("other")), "key", "left")
    assert joined.count() == texts.count()
    assert joined.filter(F.col("top_block") != F.coalesce("other", F.lit("UNKNOWN"))).isEmpty()


def test_text_without_letters(spark, blocks):
    (row,) = bl.top_blocks(_texts(spark, ["_ 1"]), ["key"], bl.letter_runs("text"), blocks).collect()
    assert row.top_block == "UNKNOWN"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("中文", "Chinese"), ("中文の", "Japanese"), ("中文 カ", "Japanese"),
        ("中文 한", "Korean"), ("中 か 한", "Japanese"),
    ],
)
def test_cjk_rule(spark, blocks, text, expected):
    profile = bl.count_blocks(_texts(spark, [text]), "key", "text", blocks)
    assert bl.cjk_rule(profile, "key").first().cjk_language == expected


def test_every_distinctive_letter_and_the_order(spark):
    cases = []
    for group, entries in DISTINCTIVE_LETTERS.items():
        script = "BASIC LATIN" if group == "LATIN" else group
        cases += [(script, f"x{c}x", language) for language, cs in entries for c in cs]
    cases += [
        ("EXTENDED LATIN", "ñ đ", "Vietnamese"), ("EXTENDED LATIN", "ß ñ š", "Estonian"),
        ("BASIC LATIN", "abc", None), ("CYRILLIC", "аб", None), ("GREEK", "ñ", None),
    ]
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "key LONG, script STRING, text STRING, expected STRING"
    )
    got = df.withColumn("got", bl.unique_chars("text", "script"))
    assert got.filter(~F.col("got").eqNullSafe(F.col("expected"))).isEmpty()
