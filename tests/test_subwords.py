import math

import pytest

from glotsieve.operators import subwords as sw
from glotsieve.operators import vocabulary as vo
from pyspark.sql import functions as F


def _segmentations(word, scores):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in scores:
            for rest in _segmentations(word[i:], scores):
                yield [word[:i], *rest]


@pytest.mark.parametrize("word", ["abcab", "cabca", "aabbcc", "abc", "a"])
def test_lattice_equals_enumeration(word):
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bca"]
    scores = {p: math.log((i + 1) / 50) for i, p in enumerate(pieces)}
    every = [(s, math.exp(sum(scores[p] for p in s))) for s in _segmentations(word, scores)]
    total = sum(p for _, p in every)
    expected, got = {}, {}
    for pieces, p in every:
        for piece in pieces:
            expected[piece] = expected.get(piece, 0) + p / total
    for piece, p in sw.expected_pieces(word, scores, -50.0):
        got[piece] = got.get(piece, 0) + p
    assert {k: v for k, v in got.items() if v} == pytest.approx(expected)
    best, score = sw.best_pieces(word, scores, -50.0)
    assert score == pytest.approx(math.log(max(p for _, p in every)))
    assert "".join(p for p, _ in best) == word


def test_long_and_unlikely_words_do_not_underflow():
    scores = {"a": -30.0}
    assert sum(p for _, p in sw.expected_pieces("a" * 500, scores, -50.0)) == pytest.approx(500)
    assert sw.expected_pieces("é" * 500, scores, -1000.0) == []


@pytest.fixture(scope="module")
def trained(docs):
    return sw.train_subwords(vo.word_counts(docs.filter("split = 'train'")), 600)


def test_vocabulary_has_the_size_asked_for(trained):
    rows = trained.table.orderBy("token").collect()
    assert [r.token for r in rows] == list(range(600))
    assert [r.piece for r in rows[:3]] == sw.SPECIAL
    scores = [r.score for r in rows[3:]]
    assert scores == sorted(scores, reverse=True)
    assert sw.token_pieces(trained).count() == 596


def test_pieces_join_to_the_words_again(spark, trained, docs):
    pieces = {r.token: r.piece for r in trained.table.collect()}
    rows = docs.select("text", trained.units("text").alias("tokens")).collect()
    for r in rows:
        if 0 in r.tokens:
            continue
        joined = "".join(pieces[t] for t in r.tokens).replace(sw.WORD_START, " ").strip()
        assert joined == r.text
    assert sum(0 in r.tokens for r in rows) < len(rows) / 10
    unknown = spark.createDataFrame([("жж", )], "text STRING").select(trained.units("text").alias("t"))
    assert unknown.first().t.count(0) == 1


def test_too_small_a_vocabulary_is_refused(docs):
    with pytest.raises(ValueError):
        sw.train_subwords(vo.word_counts(docs), 10)


def test_training_twice_gives_equal_tables(spark):
    from glotsieve.session import settle
    from glotsieve.operators.subwords import train_subwords

    words = [("".join("abcdeorstn"[(i * k + k) % 10] for k in range(2 + i % 9)), 1 + i % 13) for i in range(400)]
    counts = settle(spark.createDataFrame(words, "word STRING, n LONG").repartition(7), "words")
    again = settle(counts.repartition(3), "words")
    tables = [sorted(map(tuple, train_subwords(c, 60, shrink=0.6).table.collect())) for c in (counts, again)]
    assert tables[0] == tables[1] and len(tables[0]) == 60


def test_seeds_of_a_very_long_word(spark):
    import time

    from glotsieve.operators.subwords import substring_counts

    word = "abcdefghijklmnopqrst" * 1000
    start = time.perf_counter()
    counts = {r.piece: r.n for r in substring_counts(spark.createDataFrame([(word, 2)], "word STRING, n LONG")).collect()}
    assert time.perf_counter() - start < 20
    assert counts["a"] == 2000 and counts["tab"] == 2 * 999 and max(map(len, counts)) == 16


def _random_words(n):
    import random

    rnd = random.Random(1)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bca", "▁", "▁a", "жж", "😀", "aaaa", "abcabcabc"]
    scores = {p: math.log(rnd.random()) for p in pieces}
    sizes = [0, 1, 3, 8, 20, 60]
    words = ["".join(rnd.choice("abcabcdж😀") for _ in range(rnd.choice(sizes))) for _ in range(n)]
    return ["▁" + word for word in words] + [""], scores, rnd


@pytest.mark.parametrize("dense, cells", [(1 << 24, 1 << 18), (0, 1 << 18), (1 << 24, 50)])
def test_words_walked_together_give_what_each_gives_alone(monkeypatch, dense, cells):
    import numpy as np

    monkeypatch.setattr(sw, "_DENSE", dense)
    monkeypatch.setattr(sw, "_CELLS", cells)
    words, scores, rnd = _random_words(300)
    ns = np.array([rnd.randrange(1, 1000) for _ in words])
    lattice = sw.Lattice(scores)
    sums = np.zeros(len(lattice.prefixes), np.int64)
    lattice.add_expected(words, ns, sums)
    alone = {}
    for word, n in zip(words, ns.tolist()):
        for piece, p in sw.expected_pieces(word, scores, lattice.floor):
            alone[piece] = alone.get(piece, 0) + n * round(p * 1_000_000)
    assert {lattice.prefixes[i]: int(sums[i]) for i in np.flatnonzero(sums)} == {p: n for p, n in alone.items() if n}
    ids = {piece: i + 3 for i, piece in enumerate(scores)}
    tokens = np.array([ids.get(prefix, sw.UNKNOWN_ID) for prefix in lattice.prefixes])
    found = dict(lattice.best_tokens(words, tokens))
    for word in words:
        best = [ids[p] if known else 0 for p, known in sw.best_pieces(word, scores, lattice.floor)[0]]
        assert found[word] == [t for i, t in enumerate(best) if t or not i or best[i - 1]]


def test_a_pass_over_many_words_is_no_walk_over_each():
    import time

    import numpy as np

    words, scores, _ = _random_words(30_000)
    start = time.process_time()
    lattice = sw.Lattice(scores)
    sums = np.zeros(len(lattice.prefixes), np.int64)
    lattice.add_expected(words, np.ones(len(words), np.int64), sums)
    # 460,000 characters, with up to nine starts each.
    assert time.process_time() - start < 4 and sums.sum() > 0


def test_texts_of_more_words_than_are_kept(spark, trained, docs, monkeypatch):
    rows = [r.text for r in docs.select("text").limit(20).collect()] + ["", None]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id INT, text STRING").coalesce(1)
    found = []
    for held, cached in ((1 << 16, 50_000), (1, 0)):
        monkeypatch.setattr(sw, "_HELD_WORDS", held)
        monkeypatch.setattr(sw, "_CACHED_WORDS", cached)
        found.append({r.id: r.t for r in texts.select("id", trained.units("text").alias("t")).collect()})
    assert found[0] == found[1] and found[0][20] == found[0][21] == [] and all(found[0][i] for i in range(20) if rows[i])


def test_query_trains_the_whole_vocabulary(spark, tmp_path):
    import random

    from glotsieve.plans.queries import QUERIES

    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghijklmnopqrst", k=9)) for _ in range(3000)]
    rows = [(i, " ".join(rnd.sample(words, 300)), "en", "src0", 0) for i in range(60)]
    columns = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["train_tokenizer"](spark, str(tmp_path)).collect()
    # 3,000 words of nine letters have far more than 2,000 pieces that occur often
    assert 2_000 < len(found) <= sw.VOCABULARY_SIZE
