"""The registered queries once more, as SQL for another engine.

Each statement states the definition of an operator (ranks by window, scores
by joins over all classes) rather than the plan Spark runs.
"""

from __future__ import annotations

from glotsieve.plans import queries as q
from glotsieve.values import (
    ALPHAS,
    BLOCK_TARGETS,
    CANDIDATES,
    DISTINCTIVE_LETTERS,
    HANGUL_BLOCKS,
    KANA_BLOCKS,
    MARGINS,
    THRESHOLDS,
)

SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Ranges of the blocks that scripts are known by, and of one
# (Hebrew) that they are not.
BLOCK_RANGES = [
    (0x0000, 0x007F, "Basic Latin"),
    (0x0080, 0x00FF, "Latin-1 Supplement"),
    (0x0100, 0x017F, "Latin Extended-A"),
    (0x0180, 0x024F, "Latin Extended-B"),
    (0x0370, 0x03FF, "Greek and Coptic"),
    (0x0400, 0x04FF, "Cyrillic"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x1100, 0x11FF, "Hangul Jamo"),
    (0x1E00, 0x1EFF, "Latin Extended Additional"),
    (0x1F00, 0x1FFF, "Greek Extended"),
    (0x2C60, 0x2C7F, "Latin Extended-C"),
    (0x2E80, 0x2EFF, "CJK Radicals Supplement"),
    (0x2F00, 0x2FDF, "Kangxi Radicals"),
    (0x3000, 0x303F, "CJK Symbols and Punctuation"),
    (0x3040, 0x309F, "Hiragana"),
    (0x30A0, 0x30FF, "Katakana"),
    (0x3100, 0x312F, "Bopomofo"),
    (0x3130, 0x318F, "Hangul Compatibility Jamo"),
    (0x31A0, 0x31BF, "Bopomofo Extended"),
    (0x31C0, 0x31EF, "CJK Strokes"),
    (0x31F0, 0x31FF, "Katakana Phonetic Extensions"),
    (0x3300, 0x33FF, "CJK Compatibility"),
    (0x3400, 0x4DBF, "CJK Unified Ideographs Extension A"),
    (0x4E00, 0x9FFF, "CJK Unified Ideographs"),
    (0xA720, 0xA7FF, "Latin Extended-D"),
    (0xA960, 0xA97F, "Hangul Jamo Extended-A"),
    (0xAB30, 0xAB6F, "Latin Extended-E"),
    (0xAC00, 0xD7AF, "Hangul Syllables"),
    (0xD7B0, 0xD7FF, "Hangul Jamo Extended-B"),
    (0xF900, 0xFAFF, "CJK Compatibility Ideographs"),
    (0xFE30, 0xFE4F, "CJK Compatibility Forms"),
]


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _rows(rows) -> str:
    def cell(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _clean(text: str) -> str:
    digits = rf"regexp_replace(lower({text}), '\p{{Nd}}+', '', 'g')"
    return rf"trim(regexp_replace({digits}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


NAMED = f"""
named AS (
  SELECT doc_id, source, {_clean('text')} AS text,
         CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
                   WHEN 'es' THEN 'Spanish' ELSE 'unknown' END AS language
  FROM documents)"""

LABELLED = f"""{NAMED},
plain AS (
  SELECT doc_id, source, text, language,
         CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id))
                   <= count(*) OVER (PARTITION BY source)
                      - round_even(count(*) OVER (PARTITION BY source) * 0.8, 0)
              THEN 'test' ELSE 'train' END AS split
  FROM named)"""


def _by_language(english, french, german, spanish) -> str:
    return (
        f"CASE language WHEN 'English' THEN {english} WHEN 'French' THEN {french} "
        f"WHEN 'German' THEN {german} ELSE {spanish} END"
    )


def _to(alphabet: str) -> str:
    return f"translate(text, '{q.LATIN}', '{alphabet}')"


def _gaps(source: str, columns: str) -> str:
    copy = columns.replace("doc_id", "-doc_id AS doc_id")
    return f"""(SELECT {columns}, text FROM {source}
    UNION ALL SELECT {copy}, CASE doc_id % 97 WHEN 3 THEN '_ _' ELSE substr(text, 1, 2) END AS text
    FROM {source} WHERE doc_id % 97 IN (3, 4))"""


def _scripts(source: str, extra: str = "") -> str:
    other = _by_language(_to(q.GREEK), _to(q.THAI), _to(q.DEVANAGARI), _to(q.HEBREW))
    return f"""
  SELECT doc_id, source {extra},
    CASE abs(doc_id) % 10 WHEN 5 THEN {_to(q.CYRILLIC)} WHEN 6 THEN {_to(q.ARABIC)}
      WHEN 7 THEN {_to(q.HAN)} WHEN 8 THEN {other} WHEN 9 THEN {_to(q.ACCENTED)}
      ELSE text END AS text,
    CASE abs(doc_id) % 10
      WHEN 5 THEN {_by_language("'Russian'", "'Bulgarian'", "'Bulgarian'", "'Russian'")}
      WHEN 6 THEN {_by_language("'Arabic'", "'Urdu'", "'Pushto'", "'Persian'")}
      WHEN 7 THEN {_by_language("'Chinese'", "'Japanese'", "'Korean'", "'Chinese'")}
      WHEN 8 THEN {_by_language("'Greek'", "'Thai'", "'Hindi'", "'Kannada'")}
      WHEN 9 THEN {_by_language("'Polish'", "'Portuguese'", "'Romanian'", "'Italian'")}
      ELSE language END AS language
  FROM {_gaps(source, 'doc_id, source, language' + extra)}"""


# Every chain below starts from ``docs (doc_id, source, text, language, split)``.
DOCS = f"""{LABELLED},
docs AS (SELECT * FROM plain)"""
SCRIPT_DOCS = f"""{LABELLED},
docs AS ({_scripts('plain', ', split')})"""
GAP_DOCS = f"""{LABELLED},
docs AS {_gaps('plain', 'doc_id, source, language, split')}"""

# Word vocabulary of the train split: 49,999 words, id 0 for any other.
VOCABULARY = """
words AS (
  SELECT doc_id, language, split, unnest(string_split(text, ' ')) AS word
  FROM docs WHERE text <> ''),
vocabulary AS (
  SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS token
  FROM (SELECT word, count(*) AS n FROM words WHERE split = 'train' GROUP BY word)
  QUALIFY token < 50000),
tokens AS (
  SELECT doc_id, language, split, coalesce(token, 0) AS token, count(*) AS n
  FROM words LEFT JOIN vocabulary USING (word) GROUP BY ALL)"""

BAYES = f"""{VOCABULARY},
terms AS (
  SELECT language, token, CAST(sum(n) AS BIGINT) AS n
  FROM tokens WHERE split = 'train' GROUP BY ALL),
classes AS (
  SELECT language, n_docs, coalesce(n_tokens, 0) AS n_tokens,
         ln(n_docs / sum(n_docs) OVER ()) AS prior
  FROM (SELECT language, count(*) AS n_docs FROM docs WHERE split = 'train' GROUP BY ALL)
  LEFT JOIN (SELECT language, sum(n) AS n_tokens FROM terms GROUP BY ALL) USING (language)),
matched AS (
  SELECT k.doc_id, m.language, sum(k.n * (ln(m.n + 0.01::DOUBLE) - ln(0.01::DOUBLE))) AS gain
  FROM tokens k JOIN terms m USING (token) WHERE k.split = 'test' GROUP BY ALL),
sizes AS (
  SELECT docs.doc_id, text, coalesce(n, 0) AS n FROM docs
  LEFT JOIN (SELECT doc_id, sum(n) AS n FROM tokens GROUP BY ALL) USING (doc_id)
  WHERE split = 'test'),
joint AS (
  SELECT doc_id, classes.language, text,
         prior + n * (ln(0.01::DOUBLE) - ln(n_tokens + 0.01::DOUBLE * 50000))
         + coalesce(gain, 0) AS j
  FROM sizes CROSS JOIN classes LEFT JOIN matched USING (doc_id, language)),
posterior AS (
  SELECT doc_id, language, text, j,
         exp(j - max(j) OVER (PARTITION BY doc_id))
         / sum(exp(j - top)) OVER (PARTITION BY doc_id) AS p
  FROM (SELECT *, max(j) OVER (PARTITION BY doc_id) AS top FROM joint)),
best AS (
  SELECT doc_id, text, language AS best_predict, p AS best_prob, length(text) AS text_length
  FROM posterior
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, language) = 1)"""


# All documents are judged, not the test split alone.
BAYES_ALL = BAYES.replace("WHERE k.split = 'test' GROUP BY ALL", "GROUP BY ALL").replace("\n  WHERE split = 'test')", ")")


def _predicted(t: float, docs: str = DOCS, bayes: str = BAYES) -> str:
    return f"""WITH {docs}, {bayes},
thresholded AS (
  SELECT *, CASE WHEN text_length < 10 THEN {t}::DOUBLE
                 ELSE exp(1.0 / text_length) * {t} END AS threshold FROM best),
predicted AS (
  SELECT *, CASE WHEN best_prob >= threshold THEN best_predict ELSE 'UNKNOWN' END AS nb_predict
  FROM thresholded)"""


BLOCKS = f"""
ranges (block_start, block_end, block) AS (VALUES {_rows(BLOCK_RANGES)}),
targets (block, target) AS (VALUES {_rows(BLOCK_TARGETS.items())}),
letters AS (
  SELECT doc_id, letter, count(*) AS n, min(pos) AS first_pos
  FROM (SELECT doc_id, unnest(c) AS letter, generate_subscripts(c, 1) AS pos
        FROM (SELECT doc_id, string_split(text, '') AS c FROM docs WHERE text <> ''))
  WHERE regexp_full_match(letter, '\\p{{L}}') GROUP BY ALL),
profile AS (
  SELECT doc_id, block, CAST(sum(n) AS BIGINT) AS n, min(first_pos) AS first_pos,
         sum(n) / sum(sum(n)) OVER (PARTITION BY doc_id) AS share
  FROM letters JOIN (
    SELECT letter, block FROM (SELECT DISTINCT letter FROM letters)
    JOIN ranges ON unicode(letter) BETWEEN block_start AND block_end) USING (letter)
  GROUP BY doc_id, block),
largest AS (
  SELECT doc_id, block, share FROM profile
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) = 1),
top AS (
  SELECT doc_id, CASE WHEN share >= 0.3 THEN block ELSE 'UNKNOWN' END AS top_block,
         share AS top_share
  FROM docs LEFT JOIN largest USING (doc_id)),
scripts AS (
  SELECT doc_id, coalesce(target, 'UNKNOWN') AS script
  FROM top LEFT JOIN targets ON top_block = block),
cjk AS (
  SELECT doc_id, CASE WHEN bool_or(block IN ({_quoted(KANA_BLOCKS)})) THEN 'Japanese'
                      WHEN bool_or(block IN ({_quoted(HANGUL_BLOCKS)})) THEN 'Korean'
                      ELSE 'Chinese' END AS cjk_language
  FROM docs LEFT JOIN profile USING (doc_id) GROUP BY doc_id)"""


def _letters(script: str) -> str:
    group = "LATIN" if script == "LATIN" else script
    return " ".join(
        f"WHEN {_is(script)} AND regexp_matches(text, '[{letters}]') THEN '{language}'"
        for language, letters in DISTINCTIVE_LETTERS[group]
    )


def _is(script: str) -> str:
    return "script LIKE '%LATIN'" if script == "LATIN" else f"script = '{script}'"


UNIQUE = f"CASE {_letters('CYRILLIC')} {_letters('ARABIC')} {_letters('LATIN')} END"

GRAMS = """
grams AS (
  SELECT doc_id, language, split, gram, count(*) AS n
  FROM (SELECT doc_id, language, split,
               unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i+1] || c[i+2])) AS gram
        FROM (SELECT doc_id, language, split, string_split(text, '') AS c
              FROM docs WHERE length(text) >= 3))
  GROUP BY ALL),
ranked AS (
  SELECT doc_id, gram, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank
  FROM grams),
templates AS (
  SELECT language, gram, n, rank FROM (
    SELECT language, gram, n, row_number() OVER (PARTITION BY language ORDER BY n DESC, gram) AS rank
    FROM (SELECT language, gram, CAST(sum(n) AS BIGINT) AS n FROM grams
          WHERE split = 'train' GROUP BY ALL))
  WHERE rank <= 300),
template_sizes AS (SELECT language, count(*) AS size FROM templates GROUP BY ALL)"""

_PLACES = [
    (group, name, i) for group, names in CANDIDATES.items() for i, name in enumerate(names)
]

# Distances from texts to the candidates of their script group.
DISTANCES = f"""
candidates (script, language, place) AS (VALUES {_rows(_PLACES)}),
matches AS (
  SELECT r.doc_id, t.language, sum(abs(r.rank - t.rank) - 300) AS gain
  FROM ranked r JOIN templates t USING (gram) GROUP BY ALL),
distances AS (
  SELECT doc_id, language, place, CAST(300 * size + coalesce(gain, 0) AS BIGINT) AS distance
  FROM (SELECT DISTINCT doc_id FROM ranked) JOIN scripts USING (doc_id)
  JOIN candidates USING (script) JOIN template_sizes USING (language)
  LEFT JOIN matches USING (doc_id, language)),
reduced AS (
  SELECT doc_id, min(distance) AS least,
         arg_min(language, distance * 100 + place) AS nearest,
         max(CASE WHEN language = 'English' THEN distance END) AS english
  FROM distances GROUP BY doc_id),
ties AS (
  SELECT doc_id, count(*) AS n_nearest FROM distances JOIN reduced USING (doc_id)
  WHERE distance = least GROUP BY doc_id)"""


def _nearest(margin: str) -> str:
    return (
        "CASE WHEN english = least THEN 'English' "
        f"WHEN english IS NOT NULL AND least <> 0 AND (english - least) / least < {margin} "
        "THEN 'English' WHEN english IS NOT NULL OR n_nearest = 1 THEN nearest "
        "ELSE 'UNKNOWN' END"
    )


# Decisions of the script rule; chains before it bring docs, blocks and grams.
RULE = f"""
decided AS (
  SELECT doc_id, script, coalesce({UNIQUE},
           CASE WHEN script = 'CJK' THEN cjk_language
                WHEN script IN ({_quoted(CANDIDATES)}) THEN NULL
                ELSE coalesce(script, 'UNKNOWN') END) AS decided
  FROM docs LEFT JOIN scripts USING (doc_id) LEFT JOIN cjk USING (doc_id)),
ruled AS (
  SELECT doc_id, decided, least, english, nearest, n_nearest
  FROM decided LEFT JOIN reduced USING (doc_id) LEFT JOIN ties USING (doc_id))"""


def _rule_label(margin: str) -> str:
    return f"coalesce(decided, CASE WHEN least IS NULL THEN 'UNKNOWN' ELSE {_nearest(margin)} END)"


def _detected(t: float, docs: str, bayes: str = BAYES) -> str:
    return f"""{_predicted(t, docs, bayes)}, {BLOCKS}, {GRAMS}, {DISTANCES}, {RULE},
final AS (
  SELECT doc_id, best_predict, nb_predict,
         CASE WHEN nb_predict <> 'UNKNOWN' THEN nb_predict
              ELSE {_rule_label('0.006')} END AS unicode_predict
  FROM predicted JOIN ruled USING (doc_id))"""


def _rates(truth: str, predicted: str) -> dict[str, str]:
    t, p = truth, predicted
    english, other = f"{t} = 'English'", f"{t} <> 'English'"
    return {
        "accuracy": f"avg(CASE WHEN {t} = {p} THEN 1.0 ELSE 0.0 END) * 100",
        "fnr": f"count(*) FILTER ({english} AND {p} <> 'English') * 100.0"
        f" / nullif(count(*) FILTER ({english}), 0)",
        "fpr": f"count(*) FILTER ({other} AND {p} = 'English') * 100.0"
        f" / nullif(count(*) FILTER ({other}), 0)",
    }


def _figure(name: str) -> str:
    return f"""{_predicted(q.STRICT)}
SELECT round({_rates('d.language', 'best_predict')[name]}, 6) AS base,
       round({_rates('d.language', 'nb_predict')[name]}, 6) AS thresholded
FROM predicted JOIN docs d USING (doc_id)"""


_FOLD = "('0x' || substr(md5('1:' || doc_id), 1, 8))::BIGINT % 5"

# Token counts of the train split by fold, and the counts of the model that
# leaves a fold out.
FOLDS = f"""
trained AS (SELECT *, {_FOLD} AS fold FROM docs WHERE split = 'train'),
models AS (SELECT unnest(range(5)) AS model),
fold_terms AS (
  SELECT language, token, fold, sum(n) AS n
  FROM tokens JOIN trained USING (doc_id, language, split) GROUP BY ALL),
known AS (
  SELECT model, language, token, sum(n) AS n FROM fold_terms, models
  WHERE fold <> model GROUP BY ALL),
class_docs AS (
  SELECT model, language, count(*) AS n_docs FROM trained, models
  WHERE fold <> model GROUP BY ALL),
class_sizes AS (
  SELECT model, language, n_docs, coalesce(n_tokens, 0) AS n_tokens,
         ln(n_docs / sum(n_docs) OVER (PARTITION BY model)) AS prior
  FROM class_docs
  LEFT JOIN (SELECT model, language, sum(n) AS n_tokens FROM known GROUP BY ALL)
  USING (model, language)),
text_sizes AS (
  SELECT trained.doc_id, trained.language AS truth, fold, length(text) AS text_length,
         coalesce(n, 0) AS n
  FROM trained LEFT JOIN (SELECT doc_id, sum(n) AS n FROM tokens GROUP BY ALL) USING (doc_id))"""


def _cv_scores(alphas) -> str:
    return f"""WITH {DOCS}, {VOCABULARY}, {FOLDS},
alphas (alpha) AS (SELECT unnest([{', '.join(f"{a!r}::DOUBLE" for a in alphas)}])),
gains AS (
  SELECT k.doc_id, m.model, m.language, alpha, sum(k.n * (ln(m.n + alpha) - ln(alpha))) AS gain
  FROM tokens k JOIN known m USING (token) CROSS JOIN alphas WHERE k.split = 'train' GROUP BY ALL),
cv_joint AS (
  SELECT doc_id, truth, fold, text_length, model, class_sizes.language, alpha,
         prior + n * (ln(alpha) - ln(n_tokens + alpha * 50000)) + coalesce(gain, 0) AS j
  FROM text_sizes CROSS JOIN class_sizes CROSS JOIN alphas
  LEFT JOIN gains USING (doc_id, model, language, alpha)),
cv AS (
  SELECT truth, text_length, model, alpha,
         CASE WHEN fold = model THEN 'test' ELSE 'train' END AS part,
         arg_min(language, (-j, language)) AS best_predict,
         1 / sum(exp(j - top)) AS best_prob
  FROM (SELECT *, max(j) OVER (PARTITION BY doc_id, model, alpha) AS top FROM cv_joint)
  GROUP BY doc_id, truth, fold, text_length, model, alpha)"""


def _cv_table(labelled: str, parameter: str, label: str) -> str:
    figures = _rates("truth", label)
    inner = ", ".join(f"{sql} AS {name}" for name, sql in figures.items())
    outer = ", ".join(
        f"round(avg({figure}) FILTER (part = '{part}'), 6) AS {part}_{name}"
        for part in ("train", "test")
        for name, figure in (("score", "accuracy"), ("fnr", "fnr"), ("fpr", "fpr"))
    )
    return f"""SELECT {parameter}, {outer} FROM (
  SELECT {parameter}, part, model, {inner} FROM ({labelled}) GROUP BY ALL)
GROUP BY {parameter}"""


def _verdict(t: str) -> str:
    return (
        f"CASE WHEN best_prob >= CASE WHEN text_length < 10 THEN {t} "
        f"ELSE exp(1.0 / text_length) * {t} END THEN best_predict ELSE 'UNKNOWN' END"
    )


def _code3(column: str) -> str:
    return f"CASE {column} WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE 'xxx' END"


_QUOTAS = f"quotas (language, quota) AS (VALUES {_rows(q.QUOTAS.items())})"
_SAMPLED = f"""WITH {NAMED}, {_QUOTAS},
flagged AS (
  SELECT doc_id, named.language, text,
         row_number() OVER (PARTITION BY language ORDER BY md5('1:' || doc_id)) <= quota AS sampled
  FROM named JOIN quotas USING (language))"""

_REVIEWED = """reviewed AS (
  SELECT doc_id, lang AS original_language,
         CASE WHEN n_chars < 60 THEN 'remove'
              WHEN doc_id % 50 = 7 THEN NULL
              WHEN lang = 'es' AND right(source, 1) IN ('1', '3', '5', '7', '9') THEN 'pt'
              ELSE lang END AS language
  FROM documents)"""

_SCRIPTED = f"WITH {SCRIPT_DOCS}, {BLOCKS}"

SQL: dict[str, str] = {
    "scan_texts": "SELECT doc_id, text, lang, source FROM documents",
    "load_blocks": f"""{_SCRIPTED}
SELECT block, block_start::BIGINT AS block_start, block_end::BIGINT AS block_end,
       CAST(sum(n) AS BIGINT) AS n_letters, count(*) AS n_texts
FROM profile JOIN ranges USING (block) GROUP BY ALL""",
    "load_block_file": f"""{_SCRIPTED}
SELECT block, block_start::BIGINT AS block_start, block_end::BIGINT AS block_end,
       CAST(sum(n) AS BIGINT) AS n_letters, count(*) AS n_texts
FROM profile JOIN ranges USING (block) GROUP BY ALL""",
    "scan_csv": """SELECT doc_id, lang AS language,
  '"' || text || '", "said, ' || chr(10) || chr(10) || '"' AS text FROM documents""",
    "write_dataset": f"WITH {DOCS} SELECT doc_id, source, language, split, text FROM docs",
    "write_unseen": f"{_SAMPLED} SELECT doc_id, language, text FROM flagged WHERE NOT sampled",
    "write_corpus": f"""WITH {DOCS}
SELECT text, count(*) AS n FROM docs WHERE split = 'train' GROUP BY text""",
    "save_model": f"""{_detected(0.8, DOCS, BAYES_ALL)}
SELECT doc_id, unicode_predict AS predicted_language FROM final""",
    "add_source": """SELECT doc_id, text, 'documents' AS source FROM documents
UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark""",
    "standardise_columns": "SELECT doc_id, text, lang AS language FROM documents",
    "reorder_columns": f"SELECT text AS raw, doc_id, {_clean('text')} AS text, lang FROM documents",
    "drop_column": "SELECT doc_id, lang, source FROM documents",
    "filter_languages": f"""SELECT doc_id, {_code3('lang')} AS language, source FROM documents
WHERE {_code3('lang')} IN ('eng', 'fra', 'deu', 'spa')""",
    "filter_removed": f"WITH {_REVIEWED} SELECT * FROM reviewed WHERE language IS DISTINCT FROM 'remove'",
    "relabelled_rows": f"""WITH {_REVIEWED}
SELECT * FROM reviewed WHERE language IS DISTINCT FROM original_language""",
    "filter_split": f"WITH {DOCS} SELECT doc_id, language, text FROM docs WHERE split = 'test'",
    "union_sources": """SELECT doc_id AS key, text, lang AS language, source, NULL::BIGINT AS turn
FROM documents
UNION ALL SELECT item_id, text, NULL, 'benchmark', NULL FROM benchmark
UNION ALL SELECT conv_id, text, NULL, 'conversations', turn FROM conversations""",
    "dedup_rows": "SELECT DISTINCT text, lang, source FROM documents",
    "dedup_first": "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang",
    "count_removed": """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents))
AS removed FROM documents""",
    "split_train_test": f"WITH {DOCS} SELECT doc_id, source, split FROM docs",
    "split_without_source": """
SELECT doc_id, nullif(source, 'src3') AS source,
       CASE WHEN row_number() OVER (PARTITION BY nullif(source, 'src3') ORDER BY md5('1:' || doc_id))
                 <= count(*) OVER (PARTITION BY nullif(source, 'src3'))
                    - round_even(count(*) OVER (PARTITION BY nullif(source, 'src3')) * 0.8, 0)
            THEN 'test' ELSE 'train' END AS split
FROM documents""",
    "sample_per_language": f"{_SAMPLED} SELECT doc_id, language FROM flagged WHERE sampled",
    "flag_sampled": f"{_SAMPLED} SELECT doc_id, language, sampled FROM flagged",
    "unseen_rows": f"{_SAMPLED} SELECT doc_id, language FROM flagged WHERE NOT sampled",
    "sample_n": f"""SELECT doc_id, lang, text FROM documents
ORDER BY md5('1:' || doc_id) LIMIT {q.SAMPLE}""",
    "preview_rows": f"SELECT doc_id, lang, source FROM documents ORDER BY doc_id DESC LIMIT {q.TOP}",
    "iso639_1_to_language": """SELECT doc_id,
  CASE WHEN source = 'src3' THEN 'unknown' WHEN lang = 'en' THEN 'English'
       WHEN lang = 'fr' THEN 'French' WHEN lang = 'de' THEN 'German'
       WHEN lang = 'es' THEN 'Spanish' ELSE 'unknown' END AS language FROM documents""",
    "iso639_3_to_language": """SELECT doc_id,
  CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
            ELSE 'unknown' END AS language FROM documents""",
    "iso639_beyond": """SELECT doc_id,
  CASE right(source, 1) WHEN '1' THEN 'Hebrew' WHEN '2' THEN 'Norwegian'
    WHEN '3' THEN 'Swahili (macrolanguage)' WHEN '4' THEN 'Icelandic' WHEN '5' THEN 'Basque'
    WHEN '6' THEN 'unknown' ELSE 'Irish' END AS language FROM documents""",
    "replace_language": """SELECT doc_id,
  CASE lang WHEN 'en' THEN 'Greek' WHEN 'fr' THEN 'Swahili' WHEN 'de' THEN 'Pushto'
            ELSE 'Spanish' END AS language FROM documents""",
    "drop_rarest_language": f"""WITH {NAMED},
known AS (SELECT doc_id, CASE WHEN doc_id % 200 <> 11 THEN language END AS language FROM named),
counts AS (SELECT language, count(*) AS n FROM known WHERE language IS NOT NULL GROUP BY language)
SELECT doc_id, language FROM known
WHERE language IS DISTINCT FROM (SELECT language FROM counts ORDER BY n, language LIMIT 1)""",
    "lowercase": "SELECT doc_id, lower(text) AS text FROM documents",
    "collapse_whitespace": f"""SELECT doc_id, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS text
FROM documents""",
    "remove_digits": r"SELECT doc_id, regexp_replace(text, '\p{Nd}', '', 'g') AS text FROM documents",
    "pre_tokenize": r"""SELECT doc_id, trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g')) AS text
FROM documents""",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "ascii_only_flag": r"""SELECT doc_id,
  CASE WHEN regexp_full_match(text, '[\x00-\x7F]*') THEN 'Eng Unicode'
       ELSE 'Not Eng Unicode' END AS flag FROM documents""",
    "remove_non_ascii": r"""SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text
FROM documents""",
    "text_length": "SELECT doc_id, length(text) AS length FROM documents",
    "word_vocabulary": f"WITH {DOCS}, {VOCABULARY} SELECT token, word, n FROM vocabulary",
    "subword_seeds": f"""WITH {DOCS}, {VOCABULARY},
counted AS (SELECT '▁' || word AS word, count(*) AS n FROM words WHERE split = 'train' GROUP BY ALL),
cut AS (
  SELECT substr(word, i, size) AS piece, n
  FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM counted),
       (SELECT unnest([1, 2, 3, 4]) AS size)
  WHERE i + size <= length(word) + 1)
SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM cut GROUP BY piece""",
    "subword_round_trip": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "tokenize": f"""WITH {DOCS}, {VOCABULARY},
placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM docs WHERE text <> ''))
SELECT docs.doc_id, coalesce(tokens, '') AS tokens FROM docs LEFT JOIN (
  SELECT doc_id, string_agg(coalesce(token, 0)::VARCHAR, ' ' ORDER BY pos) AS tokens
  FROM placed LEFT JOIN vocabulary USING (word) GROUP BY doc_id) USING (doc_id)""",
    "vectorize": f"WITH {DOCS}, {VOCABULARY} SELECT doc_id, token, n FROM tokens",
    "nb_fit": f"WITH {DOCS}, {BAYES} SELECT language, token, n FROM terms",
    "nb_scores": f"""WITH {DOCS}, {BAYES_ALL}
SELECT doc_id, language, round(j, 6) AS log_likelihood, round(p, 6) AS probability
FROM posterior""",
    "nb_best": f"""WITH {DOCS}, {BAYES_ALL}
SELECT doc_id, best_predict, round(best_prob, 6) AS best_prob FROM best""",
    "confidence_threshold": f"""WITH lengths AS (
  SELECT doc_id, length({_clean('text')}) AS n FROM documents)
SELECT doc_id,
       round(CASE WHEN n < 10 THEN 0.8::DOUBLE ELSE exp(1.0 / n) * 0.8 END, 6) AS threshold,
       round(CASE WHEN n < 10 THEN 0.9::DOUBLE ELSE exp(1.0 / n) * 0.9 END, 6) AS threshold_tuning
FROM lengths""",
    "nb_predict": f"""{_predicted(0.8, bayes=BAYES_ALL)}
SELECT doc_id, best_predict, nb_predict, round(best_prob, 6) AS best_prob,
       round(threshold, 6) AS threshold FROM predicted""",
    "nb_ascii_override": rf"""{_predicted(q.STRICT, bayes=BAYES_ALL)}
SELECT doc_id, CASE WHEN best_prob < threshold AND regexp_full_match(text, '[\x00-\x7F]*')
                    THEN 'English' ELSE nb_predict END AS nb_predict FROM predicted""",
    "count_blocks": f"{_SCRIPTED} SELECT doc_id, block, n, round(share, 6) AS share FROM profile",
    "highest_block": f"""{_SCRIPTED}
SELECT doc_id, top_block, round(top_share, 6) AS top_share FROM top""",
    "script_of_block": f"{_SCRIPTED} SELECT doc_id, script FROM scripts",
    "cjk_rule": f"{_SCRIPTED} SELECT doc_id, cjk_language FROM cjk",
    "unique_chars": f"""{_SCRIPTED}
SELECT doc_id, script, {UNIQUE} AS language FROM docs JOIN scripts USING (doc_id)""",
    "char_ngrams": f"WITH {DOCS}, {GRAMS} SELECT doc_id, gram, n, rank FROM ranked",
    "train_ngrams": f"WITH {DOCS}, {GRAMS} SELECT language, gram, n, rank FROM templates",
    "ngram_distance": f"""WITH {GAP_DOCS}, {GRAMS},
matches AS (
  SELECT r.doc_id, t.language, sum(abs(r.rank - t.rank) - 300) AS gain
  FROM ranked r JOIN templates t USING (gram) GROUP BY ALL)
SELECT doc_id, language, CAST(300 * size + coalesce(gain, 0) AS BIGINT) AS distance
FROM (SELECT doc_id FROM docs) CROSS JOIN template_sizes
LEFT JOIN matches USING (doc_id, language)""",
    "candidate_languages": f"""{_SCRIPTED},
listed (script, candidates) AS (VALUES {_rows((g, ','.join(c)) for g, c in CANDIDATES.items())})
SELECT doc_id, script, coalesce(candidates, '') AS candidates
FROM scripts LEFT JOIN listed USING (script)""",
    "biased_min_distance": f"""WITH {GAP_DOCS}, {GRAMS},
scripts AS (SELECT doc_id, 'all' AS script FROM docs),
{DISTANCES.replace(_rows(_PLACES), _rows([('all', x, i) for i, x in enumerate(sorted(q.QUOTAS))])).replace('SELECT DISTINCT doc_id FROM ranked', 'SELECT doc_id FROM docs')},
margins (margin) AS (SELECT unnest([{', '.join(f"{m!r}::DOUBLE" for m in q.MARGINS_SHOWN)}]))
SELECT doc_id, margin, {_nearest('margin')} AS nearest
FROM reduced JOIN ties USING (doc_id), margins""",
    "closest_distance": f"""{_SCRIPTED}, {GRAMS}, {DISTANCES}
SELECT scripts.doc_id, CASE WHEN least IS NULL THEN 'UNKNOWN' ELSE {_nearest('0.006')} END AS closest
FROM scripts LEFT JOIN reduced USING (doc_id) LEFT JOIN ties USING (doc_id)""",
    "unicode_predict": f"""{_detected(q.STRICT, SCRIPT_DOCS, BAYES_ALL)}
SELECT doc_id, nb_predict, unicode_predict FROM final""",
    "language_counts": f"WITH {NAMED} SELECT language, count(*) AS n FROM named GROUP BY language",
    "split_shares": f"""WITH {DOCS}
SELECT split, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM docs GROUP BY split""",
    "accuracy": _figure("accuracy"),
    "false_negative_rate": _figure("fnr"),
    "false_positive_rate": _figure("fpr"),
    "metrics_report": f"""{_predicted(0.8)},
figures AS (
  SELECT {', '.join(f'{s} AS {n}' for n, s in _rates('d.language', 'nb_predict').items())}
  FROM predicted JOIN docs d USING (doc_id))
SELECT 'Test accuracy' AS metric, round(accuracy, 2) AS value FROM figures
UNION ALL SELECT 'Test FNR', round(fnr, 2) FROM figures
UNION ALL SELECT 'Test FPR', round(fpr, 2) FROM figures""",
    "stage_comparison": f"""{_detected(q.STRICT, SCRIPT_DOCS)},
stages AS (
  SELECT doc_id, 'base' AS stage, best_predict AS p FROM final
  UNION ALL SELECT doc_id, 'threshold', nb_predict FROM final
  UNION ALL SELECT doc_id, 'script rule', unicode_predict FROM final)
SELECT stage, {', '.join(f'round({s}, 6) AS {n}' for n, s in _rates('d.language', 'p').items())}
FROM stages JOIN docs d USING (doc_id) GROUP BY stage""",
    "unknown_profile": f"""{_predicted(q.STRICT)}
SELECT count(*) AS n, round(avg(text_length), 6) AS mean_length,
       round(avg(threshold), 6) AS mean_threshold, round(avg(best_prob), 6) AS mean_best_prob
FROM predicted WHERE nb_predict = 'UNKNOWN'""",
    "assign_folds": f"SELECT doc_id, {_FOLD} AS fold FROM documents",
    "nb_tune_alpha": _cv_scores(ALPHAS)
    + _cv_table(f"SELECT *, {_verdict('0.9::DOUBLE')} AS label FROM cv", "alpha", "label"),
    "nb_tune_threshold": _cv_scores([0.01])
    + _cv_table(
        f"SELECT *, {_verdict('t')} AS label FROM cv, "
        f"(SELECT unnest([{', '.join(f'{t!r}::DOUBLE' for t in THRESHOLDS)}]) AS t)",
        "t",
        "label",
    ),
    "unicode_tune_margin": f"""WITH {SCRIPT_DOCS}, {BLOCKS}, {GRAMS}, {DISTANCES}, {RULE},
margins (margin) AS (SELECT unnest([{', '.join(f"{m!r}::DOUBLE" for m in MARGINS)}])),
labels AS (
  SELECT docs.language AS truth, margin, model,
         CASE WHEN {_FOLD} = model THEN 'test' ELSE 'train' END AS part,
         {_rule_label('margin')} AS label
  FROM docs JOIN ruled USING (doc_id), margins, (SELECT unnest(range(5)) AS model)
  WHERE split = 'train')
{_cv_table('SELECT * FROM labels', 'margin', 'label')}""",
    "detect_language": f"""{_detected(0.8, DOCS, BAYES_ALL)}
SELECT doc_id, source, language, unicode_predict AS predicted_language
FROM final JOIN docs USING (doc_id)""",
    "detect_scripts": f"""{_detected(q.STRICT, SCRIPT_DOCS, BAYES_ALL)}
SELECT doc_id, language, unicode_predict AS predicted_language
FROM final JOIN docs USING (doc_id)""",
    "detect_unlabelled": f"""{_detected(0.8, f'''{LABELLED},
docs AS (
  SELECT doc_id, text, language, split, NULL AS role, NULL AS conv_id, NULL AS turn
  FROM plain WHERE split = 'train'
  UNION ALL
  SELECT -row_number() OVER (), {_clean('text')}, NULL, 'test', role, conv_id, turn FROM conversations)''')}
SELECT conv_id, turn, role, unicode_predict AS predicted_language
FROM final JOIN docs USING (doc_id)""",
    "build_dataset": f"""WITH
base AS (
  SELECT doc_id, text, n_chars, lang, right(source, 1) IN ('0', '2', '4', '6', '8') AS large
  FROM documents),
small AS (
  SELECT doc_id, text, n_chars, 'reviewed' AS source,
         CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
                   WHEN 'es' THEN 'Spanish' ELSE 'unknown' END AS language,
         row_number() OVER (ORDER BY md5('1:' || doc_id)) AS r, count(*) OVER () AS total
  FROM base WHERE NOT large),
reviewed AS (
  SELECT min(doc_id) AS doc_id, text, language, split, source
  FROM (SELECT *, CASE WHEN r <= total - round_even(total * 0.8, 0) THEN 'test'
                       ELSE 'train' END AS split FROM small)
  WHERE n_chars >= 60 GROUP BY text, language, split, source),
quotas (language, code, quota) AS (
  VALUES ('English', 'en', 30), ('French', 'fr', 5), ('German', 'de', 8)),
drawn AS (
  SELECT doc_id, text, language FROM base JOIN quotas ON lang = code WHERE large
  QUALIFY row_number() OVER (PARTITION BY language ORDER BY md5('1:' || doc_id)) <= quota),
chosen AS (
  SELECT *, row_number() OVER (ORDER BY md5('1:' || doc_id)) AS r, count(*) OVER () AS total
  FROM drawn)
SELECT doc_id, text, language, split, source FROM reviewed
UNION ALL
SELECT doc_id, text, language,
       CASE WHEN r <= total - round_even(total * 0.8, 0) THEN 'test' ELSE 'train' END, 'large'
FROM chosen""",
}
