import math
from collections import Counter

import pytest

from glotsieve.functions.scores import confidence_threshold, nearest_language
from glotsieve.operators import metrics as mt
from glotsieve.operators import naive_bayes as nb
from glotsieve.operators import ngrams as ng
from glotsieve.operators import rule as rl
from glotsieve.operators import tuning as tn
from glotsieve.operators import vocabulary as vo
from glotsieve.operators.sampling import fold_of
from pyspark.sql import functions as F

TRAIN = [
    ("English", "the cat sat on the mat"),
    ("English", "the dog"),
    ("French", "le chat et le chien"),
    ("German", "der hund und die katze"),
    ("German", "der der hund"),
]
TEST = ["the cat", "le hund", "unseen words only", "", "der", "und et on"]


def _bayes(train, test, size, alpha):
    """Posteriors by the textbook."""
    counts = Counter(w for _, t in train for w in t.split())
    order = sorted(counts, key=lambda w: (-counts[w], w))[: size - 1]
    ids = {w: i + 1 for i, w in enumerate(order)}
    classes = sorted({c for c, _ in train})
    terms = {c: Counter(ids.get(w, 0) for d, t in train if d == c for w in t.split()) for c in classes}
    docs = Counter(c for c, _ in train)
    results = []
    for text in test:
        joint = {}
        for c in classes:
            total = sum(terms[c].values()) + alpha * size
            joint[c] = math.log(docs[c] / len(train)) + sum(
                math.log((terms[c][ids.get(w, 0)] + alpha) / total) for w in text.split()
            )
        top = max(joint.values())
        norm = sum(math.exp(j - top) for j in joint.values())
        results.append({c: math.exp(j - top) / norm for c, j in joint.items()})
    return results


def _table(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"key LONG, {schema}")


def _model(spark, size=50, alpha=0.01, rows=TRAIN):
    train = _table(spark, rows, "language STRING, text STRING")
    words = vo.train_word_vocabulary(vo.word_counts(train), size)
    return nb.nb_fit(train, words, alpha=alpha)


@pytest.mark.parametrize("size, alpha", [(50, 0.01), (4, 1.0), (50, 1e-10)])
def test_posteriors(spark, size, alpha):
    model = _model(spark, size, alpha)
    test = _table(spark, [(t,) for t in TEST], "text STRING")
    expected = _bayes(TRAIN, TEST, size, alpha)
    rows = nb.nb_scores(test, "key", "text", model).collect()
    assert len(rows) == len(TEST) * 3
    for r in rows:
        assert r.probability == pytest.approx(expected[r.key][r.language], rel=1e-9)
    for r in nb.nb_best(test, "key", "text", model).collect():
        best = max(expected[r.key].values())
        assert r.best_prob == pytest.approx(best, rel=1e-9)
        assert expected[r.key][r.best_predict] == pytest.approx(best, rel=1e-9)


def test_scores_hold_when_weights_are_too_many_to_broadcast(spark, monkeypatch):
    model = _model(spark)
    test = _table(spark, [(t,) for t in TEST], "text STRING")
    plain = sorted(map(tuple, nb.nb_best(test, "key", "text", model).collect()))
    monkeypatch.setattr(nb, "MAX_CELLS", 0)
    salted = sorted(map(tuple, nb.nb_best(test, "key", "text", model).collect()))
    for a, b in zip(plain, salted, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])


def test_equal_classes_go_to_the_first_name(spark):
    model = _model(spark, rows=[("b", "x y"), ("a", "x y")])
    test = _table(spark, [("x",), ("",)], "text STRING")
    rows = nb.nb_best(test, "key", "text", model).collect()
    assert {r.best_predict for r in rows} == {"a"}


def test_vocabulary_and_vectors(spark):
    train = _table(spark, TRAIN, "language STRING, text STRING")
    words = vo.train_word_vocabulary(vo.word_counts(train), 4)
    ids = {r.unit: r.token for r in words.table.collect()}
    assert ids == {"der": 1, "the": 2, "hund": 3}
    assert words.table.count() == 3
    tokens = vo.tokenize(train, "key", "text", words)
    assert {r.key: r.tokens for r in tokens.collect()} == {
        0: [2, 0, 0, 0, 2, 0], 1: [2, 0], 2: [0] * 5, 3: [1, 3, 0, 0, 0], 4: [1, 1, 3],
    }
    vectors = {(r.key, r.token): r.n for r in vo.vectorize(tokens, "key", 2).collect()}
    assert vectors == {(0, 0): 4, (1, 0): 1, (2, 0): 5, (3, 0): 3, (3, 1): 1, (4, 1): 2}


def test_threshold(spark):
    rows = [(0, 0.8), (9, 0.9), (10, 0.8), (37, 0.9)]
    df = spark.createDataFrame(rows, "n INT, t DOUBLE")
    got = {r.n: r.x for r in df.select("n", confidence_threshold("n", F.col("t")).alias("x")).collect()}
    assert got == pytest.approx(
        {0: 0.8, 9: 0.9, 10: math.exp(0.1) * 0.8, 37: math.exp(1 / 37) * 0.9}
    )


def test_ascii_override(spark):
    rows = [(0.5, 0.8, "UNKNOWN", "Eng Unicode"), (0.5, 0.8, "UNKNOWN", "Not Eng Unicode"),
            (0.9, 0.8, "French", "Eng Unicode")]
    df = spark.createDataFrame(
        rows, "best_prob DOUBLE, threshold DOUBLE, nb_predict STRING, flag STRING"
    )
    assert [r.nb_predict for r in nb.nb_ascii_override(df, "flag").collect()] == [
        "English", "UNKNOWN", "French",
    ]


DISTANCES = [
    ([("French", 10), ("English", 10)], 0.0, "English"),
    ([("French", 1000), ("English", 1005)], 0.006, "English"),
    ([("French", 1000), ("English", 1006)], 0.006, "French"),
    ([("French", 1000), ("English", 1010)], 0.006, "French"),
    ([("Dutch", 10), ("French", 10), ("English", 20)], 0.01, "Dutch"),
    ([("Russian", 10), ("Bulgarian", 10)], 0.01, "UNKNOWN"),
    ([("Russian", 10), ("Bulgarian", 11)], 0.01, "Russian"),
    ([("French", 0), ("English", 5)], 0.01, "French"),
    ([("French", 0), ("English", 0)], 0.01, "English"),
    ([], 0.01, "UNKNOWN"),
    (None, 0.01, "UNKNOWN"),
]


def test_nearest_language(spark):
    df = spark.createDataFrame(
        DISTANCES,
        "d ARRAY<STRUCT<language: STRING, distance: LONG>>, margin DOUBLE, expected STRING",
    )
    got = df.withColumn("got", nearest_language("d", F.col("margin")))
    assert got.filter("got <> expected").isEmpty()


def _ranks(texts, limit=None, n=3):
    counts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    order = sorted(counts, key=lambda g: (-counts[g], g))[:limit]
    return {g: i + 1 for i, g in enumerate(order)}


def test_ngram_ranks_and_distances(spark):
    train = [("A", "abcabcab ca"), ("A", "bca"), ("B", "xyz abc"), ("B", "zzzz")]
    texts = ["abcab", "qqqqq", "ab", "zzz abc ab", "abc"]
    k = 4
    templates = ng.train_ngrams(
        _table(spark, train, "language STRING, text STRING"), k=k
    )
    expected = {c: _ranks([t for d, t in train if d == c], k) for c in "AB"}
    got = {}
    for r in templates.table.collect():
        got.setdefault(r.language, {})[r.gram] = r.rank
    assert got == expected
    df = _table(spark, [(t,) for t in texts], "text STRING")
    for r in ng.ngram_distance(df, "key", "text", templates).collect():
        ranks = _ranks([texts[r.key]])
        assert r.distance == sum(
            abs(ranks[g] - rank) if g in ranks else k for g, rank in expected[r.language].items()
        )
    keys = {r.key for r in ng.ngram_distance(df, "key", "text", templates).collect()}
    assert keys == {0, 1, 2, 3, 4}  # a text of two characters lacks every gram


def test_templates_are_limited_before_they_are_shuffled(spark, docs):
    plan = ng.char_ngrams(docs, ["language"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def _rule_label(texts, templates, margin):
    """The trigram step of the rule for Latin texts, in plain Python."""
    labels = []
    for text in texts:
        ranks = _ranks([text])
        near = [
            (sum(abs(ranks[g] - r) if g in ranks else 300 for g, r in templates[c].items()), c)
            for c in ("French", "Spanish", "German", "English")
        ]
        least = min(near)[0]
        english = next(d for d, c in near if c == "English")
        close = english == least or (least and (english - least) / least < margin)
        labels.append("English" if close else next(c for d, c in near if d == least))
    return labels


def test_rule_on_documents(spark, docs, blocks):
    train = docs.filter("split = 'train'")
    test = docs.filter("split = 'test'").select(F.col("doc_id").alias("key"), "text")
    templates = ng.train_ngrams(train)
    tables = {}
    for r in templates.table.collect():
        tables.setdefault(r.language, {})[r.gram] = r.rank
    unsure = test.select("key", F.lit("UNKNOWN").alias("nb_predict"))
    found = rl.unicode_predict(test, unsure, "key", "text", blocks, templates)
    rows = {r.key: r.unicode_predict for r in found.collect()}
    texts = {r.key: r.text for r in test.collect()}
    assert set(rows) == set(texts)
    plain = {k for k, t in texts.items() if len(t) > 2 and not set(t) & set("ñßœûÿ")}
    assert len(plain) > 10
    expected = dict(zip(sorted(plain), _rule_label([texts[k] for k in sorted(plain)], tables, 0.006)))
    assert {k: rows[k] for k in plain} == expected


SCRIPTS = [
    ("中文文本", "Chinese"), ("中文の文", "Japanese"), ("中文 한글", "Korean"), ("ภาษาไทย", "Thai"),
    ("தமிழ", "Tamil"), ("മലയാളം", "Malayalam"), ("हिनद", "Hindi"), ("ελληνικα", "Greek"),
    ("ಕನನಡ", "UNKNOWN"), ("ݐݑݒ", "UNKNOWN"), ("ёж", "Russian"), ("жз", "UNKNOWN"),
    ("ٹاب", "Urdu"), ("ښاب", "Pushto"), ("كتاب", "Arabic"), ("ab", "UNKNOWN"), ("", "UNKNOWN"),
    ("đây", "Vietnamese"), ("ạảấ", "Vietnamese"), ("kept", "Sure"),
]


def test_rule_by_script(spark, docs, blocks):
    templates = ng.train_ngrams(docs.filter("split = 'train'"))
    texts = _table(spark, [(t,) for t, _ in SCRIPTS], "text STRING")
    label = F.when(F.col("text") == "kept", "Sure").otherwise("UNKNOWN")
    predicted = texts.select("key", label.alias("nb_predict"))
    found = rl.unicode_predict(texts, predicted, "key", "text", blocks, templates)
    rows = {r.key: r.unicode_predict for r in found.collect()}
    assert [rows[i] for i in range(len(SCRIPTS))] == [e for _, e in SCRIPTS]


def test_rates(spark):
    rows = [("English", "English"), ("English", "UNKNOWN"), ("French", "English"), ("French", "French"),
            ("German", "UNKNOWN")]
    df = spark.createDataFrame(rows, "truth STRING, p STRING")
    assert tuple(df.agg(*mt.rates("truth", "p")).first()) == pytest.approx((40.0, 50.0, 100 / 3))
    none = df.filter("truth <> 'English'").agg(*mt.rates("truth", "p")).first()
    assert none.fnr is None
    assert df.filter("truth = 'English'").agg(*mt.rates("truth", "p")).first().fpr is None
    report = {r.metric: r.value for r in mt.metrics_report(df, "Test", "truth", "p").collect()}
    assert report == {"Test accuracy": 40.0, "Test FNR": 50.0, "Test FPR": 33.33}


def test_tuning_equals_fitting_every_fold(spark):
    words = "the cat dog le chat chien der hund katze und et on".split()
    rows = []
    for i in range(40):
        language = ("English", "French", "German")[i % 3]
        own = words[i % 3 * 3 : i % 3 * 3 + 3]
        rows.append((language, " ".join([own[i % 2], words[(i * 7) % 12], own[i % 3]][: i % 4])))
    df = _table(spark, rows, "language STRING, text STRING")
    vocabulary = vo.train_word_vocabulary(vo.word_counts(df), 8)
    folds = {r.key: r.f for r in df.select("key", fold_of("key").alias("f")).collect()}
    got = {}
    scored = tn.cv_predictions(df, "key", "text", "language", vocabulary, [0.01, 1.0])
    for r in scored.collect():
        got[r.key, r.model, r.alpha] = (r.part, r.best_prob)
    assert len(got) == 40 * 5 * 2
    ids = {r.unit: r.token for r in vocabulary.table.collect()}
    known = [(c, " ".join(w if w in ids else "other" for w in t.split())) for c, t in rows]
    for model in range(5):
        train = [r for i, r in enumerate(known) if folds[i] != model]
        for alpha in (0.01, 1.0):
            # Words out of the vocabulary share one id; smoothing counts 8 ids.
            expected = _bayes_fixed(train, [t for _, t in known], ids, 8, alpha)
            for i in range(40):
                part, prob = got[i, model, alpha]
                assert part == ("test" if folds[i] == model else "train")
                assert prob == pytest.approx(max(expected[i].values()), rel=1e-9)
    table = tn.nb_tune_threshold(df, "key", "text", "language", vocabulary)
    assert table.count() == 11
    assert tn.nb_tune_alpha(df, "key", "text", "language", vocabulary).count() == 11


def _bayes_fixed(train, test, ids, size, alpha):
    classes = sorted({c for c, _ in train})
    terms = {c: Counter(ids.get(w, 0) for d, t in train if d == c for w in t.split()) for c in classes}
    docs = Counter(c for c, _ in train)
    results = []
    for text in test:
        joint = {
            c: math.log(docs[c] / len(train))
            + sum(
                math.log((terms[c][ids.get(w, 0)] + alpha) / (sum(terms[c].values()) + alpha * size))
                for w in text.split()
            )
            for c in classes
        }
        top = max(joint.values())
        norm = sum(math.exp(j - top) for j in joint.values())
        results.append({c: math.exp(j - top) / norm for c, j in joint.items()})
    return results


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_of_a_text_stay_in_its_row(spark):
    rows = [(1, "abcabcab\ud55c\uae00"), (1, "bca"), (2, "ab"), (None, "xyz"), (None, "xyzx"), (3, None)]
    df = spark.createDataFrame(rows, "key LONG, text STRING")
    grams = ng.char_ngrams(df, ["key"], limit=None)
    assert "Window" not in _plan(grams) and "Generate" not in _plan(grams)
    expected = set()
    for key in {k for k, _ in rows}:
        texts = [t or "" for k, t in rows if k == key]
        counts = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
        order = sorted(counts, key=lambda g: (-counts[g], g))
        expected |= {(key, g, counts[g], i + 1) for i, g in enumerate(order)}
    assert {tuple(r) for r in grams.collect()} == expected
    templates = ng.train_ngrams(spark.createDataFrame([("x", "abcab"), ("y", "xyz")], "language STRING, text STRING"))
    distances = ng.ngram_distance(df, "key", "text", templates)
    assert "Window" not in _plan(distances) and "char_ngrams" not in _plan(distances)
    assert {(r.key, r.language): r.distance for r in distances.collect()}[(2, "y")] == 300


def test_margins_are_judged_once(spark):
    near = [("English", 10), ("French", 12)]
    rows = [(i, "English" if i % 3 else "French", None, near) for i in range(40)]
    inputs = spark.createDataFrame(
        rows, "key LONG, language STRING, decided STRING, distances ARRAY<STRUCT<language: STRING, distance: LONG>>"
    )
    tuned = tn.unicode_tune_margin(inputs, "key", "language")
    # The figures come from the settled counts; the texts' rows are not read again.
    assert "decided" not in tuned._jdf.queryExecution().analyzed().toString()
    assert tuned.count() == 10


def test_texts_are_spread_by_their_size(spark, monkeypatch):
    from glotsieve import session

    monkeypatch.setattr(session, "PART", 100)
    df = spark.createDataFrame([(i, "a" * 50) for i in range(64)], "key LONG, text STRING")
    assert session.spread(df, "key", "text").rdd.getNumPartitions() == 32
    words = vo.train_word_vocabulary(vo.word_counts(spark.createDataFrame([("a b",)], "text STRING")), 4)
    assert ", 32)" in _plan(vo.tokenize(df, "key", "text", words)).replace("REPARTITION_BY_NUM", "")


def test_vocabulary_of_fold_counts(spark):
    train = _table(spark, TRAIN, "language STRING, text STRING")
    counts = tn.fold_counts(train, "key", "text", "language").cache()
    words = vo.train_word_vocabulary(counts, 4)
    assert {r.unit: r.token for r in words.table.collect()} == {"der": 1, "the": 2, "hund": 3}
    alone = tn.nb_tune_alpha(train, "key", "text", "language", words, [0.1, 1.0])
    given = tn.nb_tune_alpha(train, "key", "text", "language", words, [0.1, 1.0], counts=counts)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, given.collect()))
