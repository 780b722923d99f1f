"""Registered queries: each runs one operator over whole tables.

``documents`` is the labelled corpus. It holds four Latin-script languages, so
operators on scripts read it transliterated: letters are mapped to those of
another script by a rule on the document, which gives every script as much
text as there is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glotsieve.functions import scores, text as tx
from glotsieve.operators import (
    blocks as bl,
    dataset as ds,
    labels as lb,
    metrics as mt,
    naive_bayes as nb,
    ngrams as ng,
    rule as rl,
    sampling as sm,
    subwords as sw,
    tuning as tn,
    vocabulary as vo,
)
from glotsieve.plans import corpus as cp
from glotsieve.plans import detect as dt
from glotsieve.session import scratch_path, settle
from glotsieve.sources import blocks as sb
from glotsieve.sources import texts as st

KEY = "doc_id"
# Quotas of the sampling queries; no class is smaller at any scale factor.
QUOTAS = {"English": 60, "French": 15, "German": 20, "Spanish": 10}
SAMPLE = 100
SUBWORDS = 2_000
# At 1 no long text is sure enough, so that all of them meet the script rule.
STRICT = 1.0
MARGINS_SHOWN = [0.0, 0.006, 0.1]
TOP = 10

# Transliterations of the letters a to z, by document.
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшы"
ARABIC = "ابتثجحخدذرزسشصضطظعغفقلمنهٹ"
HAN = "一二三四五六七八九十百千万人大小가中山川水木金土日あ"
GREEK = "αβγδεζηθικλμνξοπρστυφχψωάέ"
THAI = "กขคงจฉชซญดตถทธนบปผฝพฟภมยรล"
DEVANAGARI = "कखगघचछजझटठडढतथदधनपफबभमयरलव"
HEBREW = "אבגדהוזחטיכלמנסעפצקרשתךםןף"
ACCENTED = "abçdéfghîjklmñôpqrstúvwxyż"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return st.scan_texts(spark, f"{sf}/documents.parquet")


def named(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with cleaned text and a language name."""
    docs = documents(spark, sf).select(KEY, "source", F.col("lang").alias("language"), "text")
    docs = lb.iso639_1_to_language(docs, "language", KEY)
    return docs.withColumn("text", tx.clean_text("text"))


def split(spark: SparkSession, sf: str) -> DataFrame:
    return sm.split_train_test(named(spark, sf), KEY)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus with its split. Only the cuts of the split are written, a row a source."""
    return split(spark, sf)


def _by_language(english: str, french: str, german: str, spanish: str) -> Column:
    column = F.col("language")
    return (
        F.when(column == "English", english)
        .when(column == "French", french)
        .when(column == "German", german)
        .otherwise(spanish)
    )


def with_gaps(df: DataFrame) -> DataFrame:
    """All documents, and beside them copies of some without letters or of two characters, with keys below zero."""
    rest = F.col(KEY) % 97
    copies = F.when(rest.isin(3, 4), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    # Numbers are exploded, not texts: who reads no text does not clean it.
    both = df.select("*", F.explode(copies).alias("_copy"))
    copy = F.col("_copy") == 1
    changed = {
        KEY: F.when(copy, -F.col(KEY)).otherwise(F.col(KEY)),
        "text": F.when(copy & (rest == 3), "_ _").when(copy, F.substring("text", 1, 2)).otherwise(F.col("text")),
    }
    return both.select(*[changed[c].alias(c) if c in changed else c for c in df.columns])


def in_scripts(df: DataFrame) -> DataFrame:
    """Documents in eight scripts, half of them, with languages to match."""
    df = with_gaps(df)
    kind = F.abs(KEY) % 10

    def to(alphabet: str) -> Column:
        return F.translate("text", LATIN, alphabet)

    other = (
        F.when(F.col("language") == "English", to(GREEK))
        .when(F.col("language") == "French", to(THAI))
        .when(F.col("language") == "German", to(DEVANAGARI))
        .otherwise(to(HEBREW))
    )
    text = (
        F.when(kind == 5, to(CYRILLIC))
        .when(kind == 6, to(ARABIC))
        .when(kind == 7, to(HAN))
        .when(kind == 8, other)
        .when(kind == 9, to(ACCENTED))
        .otherwise(F.col("text"))
    )
    language = (
        F.when(kind == 5, _by_language("Russian", "Bulgarian", "Bulgarian", "Russian"))
        .when(kind == 6, _by_language("Arabic", "Urdu", "Pushto", "Persian"))
        .when(kind == 7, _by_language("Chinese", "Japanese", "Korean", "Chinese"))
        .when(kind == 8, _by_language("Greek", "Thai", "Hindi", "Kannada"))
        .when(kind == 9, _by_language("Polish", "Portuguese", "Romanian", "Italian"))
        .otherwise(F.col("language"))
    )
    return df.select(
        *[
            text.alias(c) if c == "text" else language.alias(c) if c == "language" else c
            for c in df.columns
        ]
    )


def _six(*columns: str) -> list[Column]:
    """Floats to six decimals: the order of a sum differs between engines."""
    return [F.round(c, 6).alias(c) for c in columns]


# Sources and sinks


def scan_texts(spark, sf):
    return st.scan_texts(spark, f"{sf}/documents.parquet").select(KEY, "text", "lang", "source")


def load_blocks(spark, sf):
    return _block_use(spark, sf, sb.jvm_blocks(spark))


def load_block_file(spark, sf):
    """The block table written in the form of Unicode's file, with comments, and parsed again."""
    line = F.format_string("%04X..%04X; %s", "block_start", "block_end", "block")
    lines = sb.jvm_blocks(spark).select(
        F.explode(F.array(F.lit("# Start Code..End Code; Block Name"), F.lit(""), line)).alias("value")
    )
    path = scratch_path(spark, "blocks")
    lines.write.text(path)
    return _block_use(spark, sf, settle(sb.load_blocks(spark, path), "block-table"))


def scan_csv(spark, sf):
    """Texts with line breaks, quotes and commas, written as CSV and read by a declared schema."""
    text = F.concat(F.lit('"'), F.col("text"), F.lit('", "said, \n\n"'))
    rows = st.scan_texts(spark, f"{sf}/documents.parquet").select(
        text.alias("text"), F.col("lang").alias("language"), F.col(KEY).cast("string").alias("id")
    )
    path = scratch_path(spark, "csv")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    found = st.scan_texts(spark, path, "csv", "text STRING, language STRING, id STRING")
    return found.select(F.col("id").cast("long").alias(KEY), "language", "text")


def _block_use(spark, sf, blocks):
    texts = in_scripts(named(spark, sf))
    used = bl.count_blocks(texts, KEY, "text", blocks).groupBy("block").agg(
        F.sum("n").alias("n_letters"), F.count("*").alias("n_texts")
    )
    return used.join(blocks, "block").select(
        "block",
        F.col("block_start").cast("long"),
        F.col("block_end").cast("long"),
        "n_letters",
        "n_texts",
    )


def write_dataset(spark, sf):
    path = scratch_path(spark, "dataset")
    st.write_dataset(split(spark, sf), path)
    return spark.read.parquet(path).select(KEY, "source", "language", "split", "text")


def write_unseen(spark, sf):
    path = scratch_path(spark, "unseen")
    st.write_unseen(sm.flag_sampled(named(spark, sf), KEY, quotas(spark)), path)
    return spark.read.parquet(path).select(KEY, "language", "text")


def write_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    st.write_corpus(split(spark, sf), path)
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return lines.groupBy("text").agg(F.count("*").alias("n"))


def save_model(spark, sf):
    docs = labelled(spark, sf)
    path = scratch_path(spark, "model")
    dt.save_detector(dt.train_detector(ds.filter_split(docs, "train"), tokens="word"), path)
    loaded = dt.load_detector(spark, path)
    return dt.detect_labels(docs, "text", KEY, loaded)


# Projection, filter, union, deduplication, sampling


def quotas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUOTAS.items()), "language STRING, quota INT")


def add_source(spark, sf):
    tables = {"documents": KEY, "benchmark": "item_id"}
    parts = [
        ds.add_source(
            spark.read.parquet(f"{sf}/{name}.parquet").select(F.col(key).alias(KEY), "text"), name
        )
        for name, key in tables.items()
    ]
    return ds.union_sources(*parts)


def standardise_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return ds.standardise_columns(docs, "text", "lang", KEY)


def reorder_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(KEY, "text", "lang")
    return ds.reorder_columns(docs).withColumn("text", tx.clean_text("text"))


def drop_column(spark, sf):
    return ds.drop_column(spark.read.parquet(f"{sf}/documents.parquet"), "n_chars", "text")


def _three_letter(column: str) -> Column:
    code = F.col(column)
    return (
        F.when(code == "en", "eng").when(code == "fr", "fra").when(code == "de", "deu")
        .otherwise("xxx")
    )


def filter_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coded = docs.select(KEY, _three_letter("lang").alias("language"), "source")
    return ds.filter_languages(coded, ["eng", "fra", "deu", "spa"])


def _reviewed(spark, sf):
    """Short texts are struck out, some labels are lost, and Spanish ones of odd sources corrected."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = F.substring("source", -1, 1).isin("1", "3", "5", "7", "9")
    corrected = (
        F.when(F.col("n_chars") < 60, "remove")
        .when(F.col(KEY) % 50 == 7, F.lit(None))
        .when(odd & (F.col("lang") == "es"), "pt")
        .otherwise(F.col("lang"))
    )
    return docs.select(KEY, F.col("lang").alias("original_language"), corrected.alias("language"))


def filter_removed(spark, sf):
    return ds.filter_removed(_reviewed(spark, sf))


def relabelled_rows(spark, sf):
    return ds.relabelled_rows(_reviewed(spark, sf))


def filter_split(spark, sf):
    return ds.filter_split(split(spark, sf), "test").select(KEY, "language", "text")


def union_sources(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    return ds.union_sources(
        docs.select(F.col(KEY).alias("key"), "text", F.col("lang").alias("language"), "source"),
        ds.add_source(items.select(F.col("item_id").alias("key"), "text"), "benchmark"),
        ds.add_source(turns.select(F.col("conv_id").alias("key"), "turn", "text"), "conversations"),
    )


def dedup_rows(spark, sf):
    return ds.dedup_rows(documents(spark, sf).select("text", "lang", "source"))


def dedup_first(spark, sf):
    return ds.dedup_rows(documents(spark, sf).select(KEY, "text", "lang"), KEY)


def count_removed(spark, sf):
    return ds.count_removed(documents(spark, sf), ["text", "lang"])


def split_train_test(spark, sf):
    return split(spark, sf).select(KEY, "source", "split")


def split_without_source(spark, sf):
    """Rows of one source have lost its name, and are split as a group of their own."""
    source = F.when(F.col("source") != "src3", F.col("source"))
    docs = documents(spark, sf).select(KEY, source.alias("source"))
    return sm.split_train_test(docs, KEY)


def sample_per_language(spark, sf):
    return sm.sample_per_language(named(spark, sf), KEY, quotas(spark)).select(KEY, "language")


def flag_sampled(spark, sf):
    flagged = sm.flag_sampled(named(spark, sf), KEY, quotas(spark))
    return flagged.select(KEY, "language", "sampled")


def unseen_rows(spark, sf):
    docs = named(spark, sf)
    flagged = sm.flag_sampled(docs, KEY, quotas(spark))
    return flagged.filter("not sampled").select(KEY, "language")


def sample_n(spark, sf):
    return sm.sample_n(documents(spark, sf), KEY, SAMPLE).select(KEY, "lang", "text")


def preview_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(KEY, "lang", "source")
    return ds.preview_rows(docs, F.desc(KEY), TOP)


# Labels


def iso639_1_to_language(spark, sf):
    coded = documents(spark, sf).select(
        KEY, F.when(F.col("source") == "src3", "qq").otherwise(F.col("lang")).alias("language")
    )
    return lb.iso639_1_to_language(coded, "language", KEY)


def iso639_3_to_language(spark, sf):
    coded = documents(spark, sf).select(KEY, _three_letter("lang").alias("language"))
    return lb.iso639_3_to_language(coded, "language", KEY)


def iso639_beyond(spark, sf):
    """Codes of both lengths beyond the languages of the classifier, by a rule on the source."""
    number = F.substring("source", -1, 1)
    code = (
        F.when(number == "1", "he").when(number == "2", "no").when(number == "3", "sw")
        .when(number == "4", "isl").when(number == "5", "eus").when(number == "6", "zz")
        .otherwise("ga")
    )
    coded = documents(spark, sf).select(KEY, code.alias("language"))
    return lb.code_to_language(coded, "language", KEY)


def replace_language(spark, sf):
    spelled = documents(spark, sf).select(
        KEY,
        F.when(F.col("lang") == "en", "Modern Greek (1453-)")
        .when(F.col("lang") == "fr", "Swahili (macrolanguage)")
        .when(F.col("lang") == "de", "Pashto")
        .otherwise("Spanish").alias("label"),
    )
    return spelled.select(KEY, lb.replace_language("label").alias("language"))


def drop_rarest_language(spark, sf):
    """Some labels are missing, fewer than any class has."""
    language = F.when(F.col(KEY) % 200 != 11, F.col("language")).alias("language")
    return lb.drop_rarest_language(named(spark, sf).select(KEY, language))


# Text functions


def _scalar(function: Callable[[str], Column], name: str = "text"):
    def query(spark, sf):
        return documents(spark, sf).select(KEY, function("text").alias(name))

    return query


# Tokens


def word_vocabulary(spark, sf):
    words = vo.word_vocabulary(_counts(split(spark, sf)))
    return words.select(F.col("token").cast("long"), "word", "n")


def _counts(docs):
    train = ds.filter_split(docs, "train")
    return settle(vo.word_counts(train, by=["language"]), "word-counts")


def _with_vocabulary(spark, sf):
    docs = labelled(spark, sf)
    return docs, vo.train_word_vocabulary(_counts(docs))


def tokenize(spark, sf):
    docs, words = _with_vocabulary(spark, sf)
    tokens = vo.tokenize(docs, KEY, "text", words)
    return tokens.select(KEY, F.array_join("tokens", " ").alias("tokens"))


def vectorize(spark, sf):
    docs, words = _with_vocabulary(spark, sf)
    counts = vo.vectorize(vo.tokenize(docs, KEY, "text", words), KEY)
    return counts.select(KEY, F.col("token").cast("long"), "n")


def _subwords(spark, sf):
    docs = labelled(spark, sf)
    return docs, sw.train_subwords(_counts(docs))


def subword_seeds(spark, sf):
    """How often each substring of up to four characters occurs in the words of the train split."""
    counts = _counts(split(spark, sf))
    marked = F.concat(F.lit(sw.WORD_START), F.col("word")).alias("word")
    words = counts.groupBy(marked).agg(F.sum("n").alias("n"))
    return sw.substring_counts(words, 4)


def subword_round_trip(spark, sf):
    """Pieces of every text joined again, with a vocabulary that has every character."""
    docs = split(spark, sf)
    pieces = sw.train_subwords(settle(vo.word_counts(docs), "words"), SUBWORDS, coverage=1.0)
    by_id = F.map_from_arrays(
        *[F.array(*[F.lit(x) for x in column]) for column in zip(*sorted(
            (r.token, r.piece) for r in pieces.table.collect()  # at most SUBWORDS rows
        ))]
    )
    joined = F.array_join(F.transform(pieces.units("text"), lambda i: F.try_element_at(by_id, i)), "")
    return docs.select(KEY, F.trim(F.replace(joined, F.lit(sw.WORD_START), F.lit(" "))).alias("text"))


def train_tokenizer(spark, sf):
    return _subwords(spark, sf)[1].table


def tokenize_subwords(spark, sf):
    docs, pieces = _subwords(spark, sf)
    return docs.select(KEY, F.array_join(pieces.units("text"), " ").alias("tokens"))


def token_pieces(spark, sf):
    return sw.token_pieces(_subwords(spark, sf)[1])


# Naive Bayes


def _bayes(docs):
    counts = _counts(docs)
    train = ds.filter_split(docs, "train")
    return nb.nb_fit(train, vo.train_word_vocabulary(counts), counts=counts)


def _fitted(spark, sf):
    docs = labelled(spark, sf)
    return docs, _bayes(docs)


def _predicted(spark, sf, t=scores.THRESHOLD, split=None):
    """Documents, of one split if it is named, with the four prediction columns and their language."""
    docs, model = _fitted(spark, sf)
    given = ds.filter_split(docs, split) if split else docs
    predicted = nb.nb_predict(given, KEY, "text", model, t)
    return given.select(KEY, "language", "text").join(predicted, KEY)


def nb_fit(spark, sf):
    _, model = _fitted(spark, sf)
    return model.terms.select("language", F.col("token").cast("long"), "n")


def nb_scores(spark, sf):
    docs, model = _fitted(spark, sf)
    scored = nb.nb_scores(docs, KEY, "text", model)
    return scored.select(KEY, "language", *_six("log_likelihood", "probability"))


def nb_best(spark, sf):
    docs, model = _fitted(spark, sf)
    best = nb.nb_best(docs, KEY, "text", model)
    return best.select(KEY, "best_predict", *_six("best_prob"))


def confidence_threshold(spark, sf):
    length = tx.text_length(tx.clean_text("text"))
    return documents(spark, sf).select(
        KEY,
        F.round(scores.confidence_threshold(length), 6).alias("threshold"),
        F.round(scores.confidence_threshold(length, 0.9), 6).alias("threshold_tuning"),
    )


def nb_predict(spark, sf):
    predicted = _predicted(spark, sf)
    return predicted.select(
        KEY, "best_predict", "nb_predict", *_six("best_prob", "threshold")
    )


def nb_ascii_override(spark, sf):
    predicted = _predicted(spark, sf, STRICT)
    override = nb.nb_ascii_override(predicted, tx.ascii_only_flag("text"))
    return override.select(KEY, "nb_predict")


# Blocks


def _profile(spark, sf, keep=True):
    texts = in_scripts(named(spark, sf))
    return bl.count_blocks(texts, KEY, "text", sb.jvm_blocks(spark), keep)


def count_blocks(spark, sf):
    return _profile(spark, sf, keep=False).select(KEY, "block", "n", *_six("share"))


def highest_block(spark, sf):
    return bl.highest_block(_profile(spark, sf), KEY).select(KEY, "top_block", *_six("top_share"))


def script_of_block(spark, sf):
    top = bl.highest_block(_profile(spark, sf), KEY)
    return top.select(KEY, bl.script_of_block("top_block").alias("script"))


def _with_script(spark, sf):
    # Texts are moved by key, so that work on them is shared out by their
    # size; the narrow script table is hashed next to them.
    texts = in_scripts(labelled(spark, sf)).repartition(KEY)
    top = bl.highest_block(
        bl.count_blocks(texts, KEY, "text", sb.jvm_blocks(spark), keep=True), KEY
    ).select(KEY, bl.script_of_block("top_block").alias("script"))
    return texts.join(top.hint("shuffle_hash"), KEY)


def cjk_rule(spark, sf):
    return bl.cjk_rule(_profile(spark, sf), KEY)


def unique_chars(spark, sf):
    found = bl.unique_chars("text", "script").alias("language")
    return _with_script(spark, sf).select(KEY, "script", found)


# N-grams


def char_ngrams(spark, sf):
    grams = ng.char_ngrams(named(spark, sf), [KEY], limit=None)
    return grams.select(KEY, "gram", "n", F.col("rank").cast("long"))


def train_ngrams(spark, sf):
    grams = ng.char_ngrams(ds.filter_split(split(spark, sf), "train"), ["language"])
    return grams.select("language", "gram", "n", F.col("rank").cast("long"))


def _templates(docs):
    return ng.train_ngrams(ds.filter_split(docs, "train"))


def ngram_distance(spark, sf):
    docs = with_gaps(labelled(spark, sf))
    return ng.ngram_distance(docs, KEY, "text", _templates(docs))


def biased_min_distance(spark, sf):
    docs = with_gaps(labelled(spark, sf))
    distances = ng.ngram_distance(docs, KEY, "text", _templates(docs))
    in_order = F.array_sort(F.collect_list(F.struct("language", "distance")))
    margins = F.array(*[F.lit(m) for m in MARGINS_SHOWN])
    return (
        distances.groupBy(KEY)
        .agg(in_order.alias("distances"))
        .select(KEY, "distances", F.explode(margins).alias("margin"))
        .select(
            KEY, "margin", scores.nearest_language("distances", F.col("margin")).alias("nearest")
        )
    )


def candidate_languages(spark, sf):
    listed = ng.candidate_languages(_with_script(spark, sf))
    return listed.select(
        KEY, "script", F.array_join(F.coalesce("candidates", F.array()), ",").alias("candidates")
    )


def closest_distance(spark, sf):
    texts = _with_script(spark, sf)
    # Templates need no script; a row without a key has none and is left out.
    templates = _templates(in_scripts(labelled(spark, sf)).filter(F.col(KEY).isNotNull()))
    return rl.closest_distance(texts, KEY, "text", "script", templates)


def unicode_predict(spark, sf):
    docs = in_scripts(labelled(spark, sf))
    train = ds.filter_split(docs, "train")
    model = _bayes(docs)
    # Three steps read the texts by key; one exchange serves them all.
    texts = docs.select(KEY, "text").repartition(KEY)
    predicted = nb.nb_predict(texts, KEY, "text", model, STRICT)
    return rl.unicode_predict(
        texts, predicted, KEY, "text", sb.jvm_blocks(spark), ng.train_ngrams(train)
    )


# Metrics


def language_counts(spark, sf):
    return mt.language_counts(named(spark, sf).select("language"))


def split_shares(spark, sf):
    shares = mt.split_shares(split(spark, sf).select("split"))
    return shares.select("split", *_six("share"))


def _one_figure(figure):
    def query(spark, sf):
        predicted = _predicted(spark, sf, STRICT, "test")
        return predicted.agg(
            F.round(figure(F.col("language"), F.col("best_predict")), 6).alias("base"),
            F.round(figure(F.col("language"), F.col("nb_predict")), 6).alias("thresholded"),
        )

    return query


def metrics_report(spark, sf):
    return mt.metrics_report(_predicted(spark, sf, split="test"), "Test", "language", "nb_predict")


def stage_comparison(spark, sf):
    docs = in_scripts(labelled(spark, sf))
    train, test = ds.filter_split(docs, "train"), ds.filter_split(docs, "test")
    model = _bayes(docs)
    # Three steps read the texts by key; one exchange serves them all.
    texts = test.select(KEY, "text", "language").repartition(KEY)
    predicted = nb.nb_predict(texts, KEY, "text", model, STRICT).join(
        texts.select(KEY, "language"), KEY
    )
    ruled = rl.rule_inputs(
        texts, predicted, KEY, "text", sb.jvm_blocks(spark), ng.train_ngrams(train),
        carry=["language", "best_predict"],
    ).withColumn("unicode_predict", rl.rule_label())
    stages = {"base": "best_predict", "threshold": "nb_predict", "script rule": "unicode_predict"}
    compared = mt.stage_comparison(ruled, "language", stages)
    return compared.select("stage", *_six("accuracy", "fnr", "fpr"))


def unknown_profile(spark, sf):
    profile = mt.unknown_profile(_predicted(spark, sf, STRICT, "test"))
    return profile.select("n", *_six("mean_length", "mean_threshold", "mean_best_prob"))


# Tuning


def assign_folds(spark, sf):
    docs = documents(spark, sf).select(KEY)
    return sm.assign_folds(docs, KEY).withColumn("fold", F.col("fold").cast("long"))


CV_COLUMNS = [
    f"{part}_{name}" for part in ("train", "test") for name in ("score", "fnr", "fpr")
]


def _with_folds(spark, sf):
    """The train split, and its words counted once: for the vocabulary and for the held-out models."""
    train = ds.filter_split(labelled(spark, sf), "train")
    counts = settle(tn.fold_counts(train, KEY, "text", "language"), "fold-counts")
    return train, vo.train_word_vocabulary(counts), counts


def nb_tune_alpha(spark, sf):
    train, words, counts = _with_folds(spark, sf)
    tuned = tn.nb_tune_alpha(train, KEY, "text", "language", words, counts=counts)
    return tuned.select("alpha", *_six(*CV_COLUMNS))


def nb_tune_threshold(spark, sf):
    train, words, counts = _with_folds(spark, sf)
    tuned = tn.nb_tune_threshold(train, KEY, "text", "language", words, counts=counts)
    return tuned.select("t", *_six(*CV_COLUMNS))


def unicode_tune_margin(spark, sf):
    docs = in_scripts(labelled(spark, sf))
    train = ds.filter_split(docs, "train")
    texts = train.select(KEY, "text", "language").repartition(KEY)
    unsure = texts.select(KEY, "language", F.lit(rl.UNKNOWN).alias("nb_predict"))
    inputs = rl.rule_inputs(
        texts, unsure, KEY, "text", sb.jvm_blocks(spark), ng.train_ngrams(train),
        carry=["language"],
    )
    tuned = tn.unicode_tune_margin(inputs, KEY, "language")
    return tuned.select("margin", *_six(*CV_COLUMNS))


# End to end


def detect_language(spark, sf):
    docs = labelled(spark, sf)
    detector = dt.train_detector(ds.filter_split(docs, "train"), tokens="word")
    found = dt.detect_language(docs, "text", detector)
    return found.select(KEY, "source", "language", "predicted_language")


def detect_scripts(spark, sf):
    docs = in_scripts(labelled(spark, sf))
    detector = dt.train_detector(
        ds.filter_split(docs, "train"), tokens="word", threshold=STRICT
    )
    found = dt.detect_language(docs, "text", detector)
    return found.select(KEY, "language", "predicted_language")


def detect_unlabelled(spark, sf):
    """Conversation turns judged by a detector trained on the documents."""
    turns = st.scan_texts(spark, f"{sf}/conversations.parquet")
    detector = dt.train_detector(
        ds.filter_split(labelled(spark, sf), "train"), tokens="word"
    )
    found = dt.detect_language(turns, "text", detector)
    return found.select("conv_id", "turn", "role", "predicted_language")


def detect_subwords(spark, sf):
    docs = labelled(spark, sf)
    detector = dt.train_detector(
        ds.filter_split(docs, "train"), tokens="subword", size=SUBWORDS
    )
    found = dt.detect_language(docs, "text", detector)
    return found.select(KEY, "language", "predicted_language")


def build_dataset(spark, sf):
    docs = documents(spark, sf).select(KEY, "text", "lang", "source", "n_chars")
    large = F.substring("source", -1, 1).isin("0", "2", "4", "6", "8")
    small = docs.filter(~large)
    corrections = small.filter(F.col("n_chars") < 60).select(
        KEY, F.lit("remove").alias("corrected")
    )
    corpus, _ = cp.build_dataset(
        [cp.Source("reviewed", small, language="lang", labels="iso639-1")],
        cp.Source(
            "large",
            docs.filter(large).withColumn("code3", _three_letter("lang")),
            language="code3",
            labels="iso639-3",
        ),
        spark.createDataFrame(
            [("English", 30), ("French", 5), ("German", 8)], "language STRING, quota INT"
        ),
        KEY,
        corrections,
    )
    return corpus.select(KEY, "text", "language", "split", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_texts": scan_texts,
    "load_blocks": load_blocks,
    "load_block_file": load_block_file,
    "scan_csv": scan_csv,
    "write_dataset": write_dataset,
    "write_unseen": write_unseen,
    "write_corpus": write_corpus,
    "save_model": save_model,
    "add_source": add_source,
    "standardise_columns": standardise_columns,
    "reorder_columns": reorder_columns,
    "drop_column": drop_column,
    "filter_languages": filter_languages,
    "filter_removed": filter_removed,
    "relabelled_rows": relabelled_rows,
    "filter_split": filter_split,
    "union_sources": union_sources,
    "dedup_rows": dedup_rows,
    "dedup_first": dedup_first,
    "count_removed": count_removed,
    "split_train_test": split_train_test,
    "split_without_source": split_without_source,
    "sample_per_language": sample_per_language,
    "flag_sampled": flag_sampled,
    "unseen_rows": unseen_rows,
    "sample_n": sample_n,
    "preview_rows": preview_rows,
    "iso639_1_to_language": iso639_1_to_language,
    "iso639_3_to_language": iso639_3_to_language,
    "iso639_beyond": iso639_beyond,
    "replace_language": replace_language,
    "drop_rarest_language": drop_rarest_language,
    "lowercase": _scalar(tx.lowercase),
    "collapse_whitespace": _scalar(tx.collapse_whitespace),
    "remove_digits": _scalar(tx.remove_digits),
    "pre_tokenize": _scalar(tx.pre_tokenize),
    "clean_text": _scalar(tx.clean_text),
    "ascii_only_flag": _scalar(tx.ascii_only_flag, "flag"),
    "remove_non_ascii": _scalar(tx.remove_non_ascii),
    "text_length": _scalar(lambda c: tx.text_length(c).cast("long"), "length"),
    "word_vocabulary": word_vocabulary,
    "tokenize": tokenize,
    "vectorize": vectorize,
    "subword_seeds": subword_seeds,
    "subword_round_trip": subword_round_trip,
    "train_tokenizer": train_tokenizer,
    "tokenize_subwords": tokenize_subwords,
    "token_pieces": token_pieces,
    "nb_fit": nb_fit,
    "nb_scores": nb_scores,
    "nb_best": nb_best,
    "confidence_threshold": confidence_threshold,
    "nb_predict": nb_predict,
    "nb_ascii_override": nb_ascii_override,
    "count_blocks": count_blocks,
    "highest_block": highest_block,
    "script_of_block": script_of_block,
    "cjk_rule": cjk_rule,
    "unique_chars": unique_chars,
    "char_ngrams": char_ngrams,
    "train_ngrams": train_ngrams,
    "ngram_distance": ngram_distance,
    "candidate_languages": candidate_languages,
    "biased_min_distance": biased_min_distance,
    "closest_distance": closest_distance,
    "unicode_predict": unicode_predict,
    "language_counts": language_counts,
    "split_shares": split_shares,
    "accuracy": _one_figure(mt.accuracy),
    "false_negative_rate": _one_figure(mt.false_negative_rate),
    "false_positive_rate": _one_figure(mt.false_positive_rate),
    "metrics_report": metrics_report,
    "stage_comparison": stage_comparison,
    "unknown_profile": unknown_profile,
    "assign_folds": assign_folds,
    "nb_tune_alpha": nb_tune_alpha,
    "nb_tune_threshold": nb_tune_threshold,
    "unicode_tune_margin": unicode_tune_margin,
    "detect_language": detect_language,
    "detect_scripts": detect_scripts,
    "detect_unlabelled": detect_unlabelled,
    "detect_subwords": detect_subwords,
    "build_dataset": build_dataset,
}
