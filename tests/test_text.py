import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glotsieve.functions import text as tx
from pyspark.sql import functions as F

CLEAN = [
    ("Tab\there\nand there　too", "tab here and there too"),
    ("a1b", "ab"),
    ("a 1 b", "a b"),
    ("don't", "don t"),
    ("x_y", "x_y"),
    ("١٢ س", "س"),
    ("éte", "e te"),
    ("กับ", "ก บ"),
    ("हिन", "ह न"),
    ("", ""),
    (None, ""),
    ("12 345", ""),
    ("  Straße -- ÉTÉ!  ", "straße été"),
]


def _column(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id LONG, text STRING")
    return [r.x for r in df.select("id", expr.alias("x")).orderBy("id").collect()]


def test_clean_text(spark):
    got = _column(spark, [t for t, _ in CLEAN], tx.clean_text("text"))
    assert got == [e for _, e in CLEAN]
    assert _column(spark, got, tx.clean_text("text")) == got  # idempotent


def test_clean_text_is_the_four_steps_in_order(spark):
    values = [t for t, _ in CLEAN]
    steps = tx.pre_tokenize(tx.remove_digits(tx.collapse_whitespace(tx.lowercase("text"))))
    assert _column(spark, values, steps) == _column(spark, values, tx.clean_text("text"))


def test_whitespace_is_what_python_calls_whitespace(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert _column(spark, [f"a{s}{s}b" for s in spaces], tx.collapse_whitespace("text")) == [
        "a b"
    ] * len(spaces)
    others = ["​", "᠎", "﻿"]
    assert _column(spark, others, tx.collapse_whitespace("text")) == others


def test_ascii(spark):
    values = ["abc\n", "é", "", "\U0001f600x"]
    assert _column(spark, values, tx.ascii_only_flag("text")) == [
        "Eng Unicode", "Not Eng Unicode", "Eng Unicode", "Not Eng Unicode",
    ]
    assert _column(spark, values, tx.remove_non_ascii("text")) == ["abc\n", "", "", "x"]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_ngrams_cross_spaces_and_count_code_points(spark, n):
    values = ["", "ab", "abc", "a b\nc", "a\U00010348b\U0001f600\U0001f601", "été ça"]
    expected = [[t[i : i + n] for i in range(len(t) - n + 1)] for t in values]
    assert _column(spark, values, tx.char_ngrams("text", n)) == expected


def test_letter_runs_hold_every_composed_letter(spark):
    letters = "aZ éÿ1жЖ 中文가 豈 Å 각 각 \U00010400"
    (runs,) = _column(spark, [letters], tx.letter_runs("text"))
    composed = [c for c in unicodedata.normalize("NFC", letters) if c.isalpha()]
    assert len("".join(runs)) == len(composed)
    blocks = [unicodedata.name(c).split()[0] for c in "".join(runs)]
    assert blocks == [unicodedata.name(c).split()[0] for c in composed]


def test_nfc_composes_marks(spark):
    values = ["é", "plain", "क़", None]
    assert _column(spark, values, tx.nfc("text")) == ["é", "plain", "क़", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=30), min_size=20, max_size=40))
def test_ngrams_of_any_text(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    expected = [[t[i : i + 3] for i in range(len(t) - 2)] for t in values]
    assert _column(spark, values, tx.char_ngrams("text")) == expected


def test_seeded_hash_depends_on_seed_and_key_only(spark):
    a, b = _column(spark, ["x", "x"], F.concat(tx.seeded_hash("text", 1)))
    assert a == b
    assert _column(spark, ["x"], tx.seeded_hash("text", 2)) != [a]


def test_words_of_one_block_are_one_run(spark):
    values = ["the quick brown fox", "\u03b1\u03b2 \u03b3 \u05d0\u05d1 \u05d2 \u0905 \u0906", "\u1100 \u1161"]
    runs = _column(spark, values, tx.letter_runs("text"))
    assert [len(r) for r in runs] == [1, 3, 2]


def test_clean_texts_are_only_looked_at_and_others_cleaned_in_full(spark):
    """Every character, alone and beside letters, gives what the three steps give."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    odd = ["", " ", "  ", "a ", " a", "a  b", "a b", "ab_c d", "straße é", "日本 語", "ΑΣ1Β ΑΣ", "a\n", "a\n b", "\na", None]
    rows = [(x,) for c in range(0, len(chars), 64) for x in [" b".join(chars[c : c + 64])]]
    rows += [(f"a{c}b",) for c in chars if c.isalnum() or not c.isprintable()] + [(x,) for x in odd]
    df = spark.createDataFrame(rows, "text STRING").select("text", tx.clean_text("text").alias("clean"))
    steps = tx.pre_tokenize(tx.remove_digits(tx.lowercase("text")))
    assert df.filter(~F.col("clean").eqNullSafe(steps)).count() == 0
    assert df.filter(~F.col("clean").eqNullSafe(tx.pre_tokenize(tx.remove_digits(tx.lowercase("clean"))))).count() == 0
