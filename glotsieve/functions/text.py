"""Scalar text functions: column expressions only, all inside codegen.

Java's ``\\s``, ``\\d`` and ``\\w`` are ASCII by default and its Unicode ``\\w``
includes combining marks, so every class below is spelled out.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
DIGITS = r"\p{Nd}+"
NON_WORD = r"[^\p{L}\p{N}_]+"
ASCII_ONLY = r"^[\x00-\x7F]*\z"
NON_ASCII = r"[^\x00-\x7F]+"
# What cleaning may change. Letters without case, and small ones, stay as they are.
UNCLEAN = r"[^\p{Ll}\p{Lo}_ ]| (?: |\z)|\A "
# A lone second half of a surrogate pair: an empty match may land there.
_HALF_PAIR = r"\x{DC00}-\x{DFFF}"


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lowercase(col: Column | str) -> Column:
    return F.lower(_text(col))


def collapse_whitespace(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(col), SPACES, " "))


def remove_digits(col: Column | str) -> Column:
    return F.regexp_replace(_text(col), DIGITS, "")


def pre_tokenize(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(col), NON_WORD, " "))


def clean_text(col: Column | str) -> Column:
    """Lower case, no digits, words joined by single spaces; null becomes ''.

    Whitespace lies outside the kept class, so splitting into words also
    collapses it and no separate pass is needed. A text that is clean already
    is only looked at.
    """
    col = _text(col)
    return F.when(col.rlike(UNCLEAN), pre_tokenize(remove_digits(lowercase(col)))).otherwise(col)


def words(clean: Column | str) -> Column:
    """Words of a cleaned text, or null when there are none."""
    clean = _text(clean)
    return F.when(clean != "", F.split(clean, " "))


def text_length(col: Column | str) -> Column:
    return F.length(_text(col))


def ascii_only_flag(col: Column | str) -> Column:
    return F.when(_text(col).rlike(ASCII_ONLY), "Eng Unicode").otherwise("Not Eng Unicode")


def remove_non_ascii(col: Column | str) -> Column:
    return F.regexp_replace(_text(col), NON_ASCII, "")


def char_ngrams(col: Column | str, n: int = 3) -> Column:
    """All overlapping character n-grams, left to right, in one linear scan.

    The look-ahead consumes nothing, so every character starts a gram;
    characters beyond U+FFFF count as one.
    """
    gram = f"(?s)(?=([^{_HALF_PAIR}]{'.' * (n - 1)}))"
    return F.regexp_extract_all(_text(col), F.lit(gram), F.lit(1))


def letter_runs(col: Column | str) -> Column:
    """Letters in order, runs within one frequent block kept together.

    A run counts as many letters as it is long. Spaces are taken out after
    composition, so that a Latin text yields a run at each change of block, such
    as an accent, rather than one a word or a letter.
    """
    runs = "|".join(
        [
            r"[A-Za-z]+",
            r"[\x{C0}-\x{FF}&&\p{L}]+",
            r"[\x{370}-\x{3FF}&&\p{L}]+",
            r"[\x{400}-\x{4FF}&&\p{L}]+",
            r"[\x{590}-\x{5FF}&&\p{L}]+",
            r"[\x{600}-\x{6FF}&&\p{L}]+",
            r"[\x{900}-\x{97F}&&\p{L}]+",
            r"[\x{E00}-\x{E7F}&&\p{L}]+",
            r"[\x{4E00}-\x{9FFF}&&\p{L}]+",
            r"[\x{AC00}-\x{D7AF}&&\p{L}]+",
            r"\p{L}",
        ]
    )
    letters = F.replace(compose_letters(col), F.lit(" "), F.lit(""))
    return F.regexp_extract_all(letters, F.lit(runs), F.lit(0))


@lru_cache(maxsize=1)
def _canonical_singles() -> tuple[str, str]:
    """Letters whose canonical composition is another letter, from Unicode data."""
    before, after = [], []
    for code in range(0x340, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or not char.isalpha():
            continue
        composed = unicodedata.normalize("NFC", char)
        if composed != char and composed[0].isalpha():
            before.append(char)
            after.append(composed[0])
    return "".join(before), "".join(after)


@lru_cache(maxsize=1)
def _may_compose() -> str:
    """A short class that holds all those letters, and conjoining jamo.

    Letters less than 32 apart share a range: the class only spares texts the
    slower replacements, so it may hold more than it must.
    """
    codes = sorted({*map(ord, _canonical_singles()[0]), *range(0x1100, 0x1200)})
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - ranges[-1][1] < 32:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges) + "]"


# Conjoining jamo: a leading consonant, a vowel and perhaps a final consonant
# make one Hangul syllable; so do a syllable without final and a final.
_JAMO_SYLLABLE = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?"
_OPEN_SYLLABLES = "".join(chr(0xAC00 + 28 * i) for i in range(19 * 21))
_SYLLABLE_FINAL = f"[{_OPEN_SYLLABLES}]" + r"[\x{11A8}-\x{11C2}]"
_SYLLABLE = "\uac01"


def compose_letters(col: Column | str) -> Column:
    """Canonical composition, as far as it moves letters between blocks.

    Cleaned text holds no combining marks, so what is left are letters with a
    canonical replacement and conjoining jamo. Any composed syllable is
    written as one and the same: only its block is ever looked at.
    ``nfc`` composes any text fully.
    """
    col = _text(col)
    before, after = _canonical_singles()
    replaced = F.translate(col, before, after)
    jamo = F.regexp_replace(replaced, _SYLLABLE_FINAL, _SYLLABLE)
    jamo = F.regexp_replace(jamo, _JAMO_SYLLABLE, _SYLLABLE)
    return F.when(col.rlike(_may_compose()), jamo).otherwise(col)


def nfc(col: Column | str) -> Column:
    """Full canonical composition, for text that still holds combining marks.

    Spark has no such function, so the texts that may need it go through an
    Arrow batch; all others are sent as nulls and kept as they are.
    """

    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFC")

    col = _text(col)
    return F.coalesce(compose(F.when(col.rlike(r"[^\x00-\x{2FF}]"), col)), col)


def seeded_hash(key: Column | str, seed: int = 1) -> Column:
    """A fixed pseudo-random order of keys that any engine can reproduce."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
