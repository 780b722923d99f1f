"""Fixed values.

Every literal here is a value that results depend on: label spellings,
Unicode block names, letter sets and tuned parameters. They are data, kept in
one place and in natural order.
"""

from __future__ import annotations

UNKNOWN = "UNKNOWN"  # label of a text the classifier will not commit to
UNKNOWN_CODE = "unknown"  # label of an ISO code that has no name
REMOVE = "remove"  # label of a row a reviewer struck out
ENGLISH = "English"

# Tuned parameters of the published model.
VOCABULARY_SIZE = 50_000
ALPHA = 0.01
TUNING_THRESHOLD = 0.9
THRESHOLD = 0.8
GRAM_SIZE = 3
TEMPLATE_SIZE = 300
MARGIN = 0.006
SHORT_TEXT = 10
BLOCK_SHARE = 0.3
TRAIN_SHARE = 0.8
FOLDS = 5
SEED = 1

ALPHAS = [1e-10, 1e-9, 1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0]
THRESHOLDS = [0.8, 0.81, 0.82, 0.83, 0.84, 0.85, 0.86, 0.87, 0.88, 0.89, 0.9]
MARGINS = [0.001, 0.002, 0.003, 0.004, 0.005, 0.006, 0.007, 0.008, 0.009, 0.01]

# The 32 languages: label, ISO 639-1 code, its ISO name, ISO 639-3 code, its
# ISO name, rows drawn from the large source when a corpus is built.
LANGUAGES = [
    ("Arabic", "ar", "Arabic", "ara", "Arabic", 3018),
    ("Bulgarian", "bg", "Bulgarian", "bul", "Bulgarian", 2250),
    ("Chinese", "zh", "Chinese", "cmn", "Mandarin Chinese", 2750),
    ("Danish", "da", "Danish", "dan", "Danish", 4572),
    ("Dutch", "nl", "Dutch", "nld", "Dutch", 3023),
    ("English", "en", "English", "eng", "English", 3443),
    ("Estonian", "et", "Estonian", "est", "Estonian", 3693),
    ("French", "fr", "French", "fra", "French", 3257),
    ("German", "de", "German", "deu", "German", 2485),
    ("Greek", "el", "Modern Greek (1453-)", "ell", "Modern Greek (1453-)", 2433),
    ("Hindi", "hi", "Hindi", "hin", "Hindi", 2782),
    ("Indonesian", "id", "Indonesian", "ind", "Indonesian", 4000),
    ("Italian", "it", "Italian", "ita", "Italian", 2599),
    ("Japanese", "ja", "Japanese", "jpn", "Japanese", 2750),
    ("Kannada", "kn", "Kannada", "kan", "Kannada", 176),
    ("Korean", "ko", "Korean", "kor", "Korean", 4000),
    ("Latin", "la", "Latin", "lat", "Latin", 4000),
    ("Malayalam", "ml", "Malayalam", "mal", "Malayalam", 878),
    ("Persian", "fa", "Persian", "pes", "Iranian Persian", 4000),
    ("Polish", "pl", "Polish", "pol", "Polish", 2250),
    ("Portuguese", "pt", "Portuguese", "por", "Portuguese", 3120),
    ("Pushto", "ps", "Pushto", "pus", "Pushto", 44),
    ("Romanian", "ro", "Romanian", "ron", "Romanian", 4000),
    ("Russian", "ru", "Russian", "rus", "Russian", 3096),
    ("Spanish", "es", "Spanish", "spa", "Spanish", 3160),
    ("Swahili", "sw", "Swahili (macrolanguage)", "swh", "Swahili (individual language)", 593),
    ("Swedish", "sv", "Swedish", "swe", "Swedish", 3324),
    ("Tamil", "ta", "Tamil", "tam", "Tamil", 402),
    ("Thai", "th", "Thai", "tha", "Thai", 2750),
    ("Turkish", "tr", "Turkish", "tur", "Turkish", 2987),
    ("Urdu", "ur", "Urdu", "urd", "Urdu", 2063),
    ("Vietnamese", "vi", "Vietnamese", "vie", "Vietnamese", 2250),
]

# Label spellings found in sources, and the label they stand for.
LABEL_ALIASES = {
    "Portugeese": "Portuguese",
    "Portugese": "Portuguese",
    "Sweedish": "Swedish",
    "Pashto": "Pushto",
    "Modern Greek (1453-)": "Greek",
    "Swahili (macrolanguage)": "Swahili",
    "Swahili (individual language)": "Swahili",
    "Iranian Persian": "Persian",
    "Mandarin Chinese": "Chinese",
}

# Script groups that several languages share.
CJK, CYRILLIC, ARABIC = "CJK", "CYRILLIC", "ARABIC"
BASIC_LATIN, EXTENDED_LATIN = "BASIC LATIN", "EXTENDED LATIN"

# Unicode block -> the language or script group it points to.
BLOCK_TARGETS = {
    "Basic Latin": "BASIC LATIN",
    "Latin-1 Supplement": "EXTENDED LATIN",
    "Latin Extended-A": "EXTENDED LATIN",
    "Latin Extended-B": "EXTENDED LATIN",
    "Greek and Coptic": "Greek",
    "Cyrillic": "CYRILLIC",
    "Arabic": "ARABIC",
    "Devanagari": "Hindi",
    "Tamil": "Tamil",
    "Malayalam": "Malayalam",
    "Thai": "Thai",
    "Hangul Jamo": "Korean",
    "Latin Extended Additional": "Vietnamese",
    "Greek Extended": "Greek",
    "Latin Extended-C": "EXTENDED LATIN",
    "CJK Radicals Supplement": "Chinese",
    "Kangxi Radicals": "Chinese",
    "CJK Symbols and Punctuation": "Chinese",
    "Hiragana": "Japanese",
    "Katakana": "Japanese",
    "Bopomofo": "Chinese",
    "Hangul Compatibility Jamo": "Korean",
    "Bopomofo Extended": "Chinese",
    "CJK Strokes": "Chinese",
    "Katakana Phonetic Extensions": "Japanese",
    "CJK Compatibility": "Chinese",
    "CJK Unified Ideographs Extension A": "Chinese",
    "CJK Unified Ideographs": "CJK",
    "Latin Extended-D": "EXTENDED LATIN",
    "Hangul Jamo Extended-A": "Korean",
    "Latin Extended-E": "EXTENDED LATIN",
    "Hangul Syllables": "Korean",
    "Hangul Jamo Extended-B": "Korean",
    "CJK Compatibility Ideographs": "Chinese",
    "CJK Compatibility Forms": "Chinese",
}

# Blocks whose presence makes a mostly-Han text Japanese or Korean.
KANA_BLOCKS = ["Hiragana", "Katakana", "Katakana Phonetic Extensions"]
HANGUL_BLOCKS = [
    "Hangul Jamo",
    "Hangul Compatibility Jamo",
    "Hangul Jamo Extended-A",
    "Hangul Syllables",
    "Hangul Jamo Extended-B",
]

# Letters that occur in one language of a script group only; first match wins.
DISTINCTIVE_LETTERS = {
    "CYRILLIC": [("Russian", "ёыэ")],
    "ARABIC": [
        ("Urdu", "ٹڈڑںھہۂے"),
        ("Pushto", "ټځڅډړږښګڼۍې"),
        ("Arabic", "إكى"),
    ],
    "LATIN": [
        ("Vietnamese", "ắằẵẳấầẫẩảạặậđếềễểẽẻẹệĩỉịốồỗổỏơớờỡởợọộũủưứừữửựụýỳỹỷỵ"),
        ("Turkish", "ğIİış"),
        ("Romanian", "șț"),
        ("Polish", "ąćęłńśźż"),
        ("French", "œûÿ"),
        ("Estonian", "šž"),
        ("Spanish", "ñ"),
        ("German", "ß"),
        ("Danish", "ø"),
    ],
}

# Candidate languages of a script group; the order decides equal distances.
EXTENDED_LATIN_LANGUAGES = [
    "Portuguese", "French", "Dutch", "Spanish", "Danish", "Italian", "Turkish",
    "Swedish", "German", "Estonian", "Romanian", "Polish", "Vietnamese",
]
BASIC_LATIN_LANGUAGES = ["English", "Latin", "Indonesian", "Swahili"]
CANDIDATES = {
    "CYRILLIC": ["Russian", "Bulgarian"],
    "ARABIC": ["Arabic", "Urdu", "Pushto", "Persian"],
    "BASIC LATIN": EXTENDED_LATIN_LANGUAGES + BASIC_LATIN_LANGUAGES,
    "EXTENDED LATIN": EXTENDED_LATIN_LANGUAGES + BASIC_LATIN_LANGUAGES,
}
