import random
import re

import numpy as np
import pyarrow as pa
import pytest

from conftest import DATA
from glotsieve.llm import ngram_jaccard as nj
from glotsieve.llm import queries
from parity import connect, differences

_UPPER = {c: c + 32 for c in range(65, 91)}


def grams(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UPPER))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, percent=75):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n):
    """Texts with copies of many kinds, common passages, and one large group of near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 4)))
    line = lambda k: [word() for _ in range(k)]
    passages = [line(30) for _ in range(4)]
    texts, base = [], line(60)
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
        elif kind < 0.6 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 2)):
                words.insert(rng.randint(0, len(words)), word())
        else:
            words = line(rng.choice([1, 3, 5, 6, 40, 90])) + rng.choice(passages) * rng.randint(0, 1)
        texts.append(rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    return texts


def test_shingles():
    for text in (None, "", " \n", "a", "A  b", "a b c d e", "a b c d e f a b c d e", "É\x0bé \x1cx　y"):
        assert len(nj.shingles(text)) == len(grams(text)), text
    assert (nj.shingles("A b\nC d e f") == nj.shingles(" a B c\td e f ")).all()
    assert set(nj.shingles("ab c d e f")) & set(nj.shingles("a bc d e f")) == set()


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices(["ab", "c", "xyz", "q" * 70], k=4000))
    whole = nj.shingles(text)
    monkeypatch.setattr(nj, "PIECE", 100)
    assert (nj.shingles(text) == whole).all() and len(whole) == len(grams(text))


def test_bitmap_is_a_bound():
    rng = np.random.default_rng(1)
    for n, m, common in ((10, 12, 9), (300, 280, 200), (70, 130, 0), (1000, 1300, 1000)):
        h = rng.integers(0, 1 << 63, n + m - common).astype(np.uint64)
        a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:common], h[n:]]))
        assert nj.least_difference(nj.bitmap(a), nj.bitmap(b)) <= n + m - 2 * common
        assert nj.least_difference(nj.bitmap(a), nj.bitmap(a)) == 0


def test_overlaps_by_fragment():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, 6000)) for _ in range(7)]
    parts = [(i, f, s[s % 3 == f]) for i, s in enumerate(sets) for f in range(3)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = nj.overlaps(parts, 7)
    assert (got[~np.eye(7, dtype=bool)] == np.array(expected)[~np.eye(7, dtype=bool)]).all()


@pytest.mark.parametrize("few, block, bits", [(8, 256, 21), (2, 8, 10), (1, 5, 16)])
def test_against_brute_force(spark, few, block, bits):
    texts = corpus(few, 160) + [None, "", " \n ", "x", "X", "only three words", "Only three\twords", "w " * 30000, "w " * 400]
    rows = [(i * 3 % 400, t) for i, t in enumerate(texts)]
    rows += [rows[0], (rows[1][0], "another text of a repeated key"), (None, rows[2][1]), (None, "no key here at all"), (None, None)]
    df = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, sid string").repartition(5)
    found = nj.near_duplicates(df, few=few, block=block, cross=2 * block, counter_bits=bits)
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found.collect()) == brute(rows)


def _copies(n, seed=4):
    """Near copies of one text, with one word changed."""
    rng = random.Random(seed)
    base = [f"word{i}" for i in range(120)]
    return [" ".join([*base[:k], f"new{rng.randrange(10**9)}", *base[k + 1 :]]) for k in (rng.randrange(120) for _ in range(n))]


def test_movement_is_linear_in_near_copies(spark, monkeypatch):
    rows = []
    linked = nj._linked

    def counted(dealt, segments, percent):
        rows.append(dealt.count())
        return linked(dealt, segments, percent)

    monkeypatch.setattr(nj, "_linked", counted)
    for n in (1000, 3000):
        rows.clear()
        df = spark.createDataFrame(list(enumerate(_copies(n))), "doc_id long, text string").repartition(6)
        found = nj.near_duplicates(df).collect()
        assert {r.component_id for r in found} == {0}
        assert sum(rows) <= 1.5 * n


def test_fragments_part_the_work(spark, monkeypatch):
    sizes = []
    settled = nj.settle

    def spied(df, name, by=None):
        out = settled(df, name, by)
        if name == "segments":
            sizes.append(out.agg({"part": "count"}).first()[0])
            sizes.append(out.selectExpr("max(size(part))").first()[0])
        return out

    monkeypatch.setattr(nj, "settle", spied)
    texts = corpus(3, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    results = [sorted(map(tuple, nj.near_duplicates(df, fragments=k, block=16).collect())) for k in (1, 8)]
    assert results[0] == results[1]
    assert sizes[2] > sizes[0] and sizes[3] < sizes[1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(4, None), (5, "")], "doc_id long, text string")
    assert sorted(map(tuple, nj.near_duplicates(df).collect())) == [(4, 0, 4), (5, 0, 5)]


def test_query(spark):
    name = "op1_ngram_jaccard"
    assert differences(queries.QUERIES[name](spark, DATA), connect(DATA), queries.SQL[name]) is None


def _passages(n, seed=5):
    """Texts of their own words around one of a few passages that very many have, not quite similar."""
    rng = random.Random(seed)
    passages = [[f"common{p}x{i}" for i in range(120)] for p in range(3)]
    own = lambda: [f"own{rng.randrange(10**9)}" for _ in range(rng.randint(7, 13))]
    return [" ".join(own() + rng.choice(passages) + own()) for _ in range(n)]


def test_sets_with_a_common_passage_meet_only_in_reach(spark, monkeypatch, tmp_path):
    may_link, folder = nj._may_link, str(tmp_path)

    def spied(percent):
        run = may_link(percent)

        def counted(table):
            with open(f"{folder}/{table['group'][0].as_py()}-{table.num_rows}", "w"):
                return run(table)

        return counted

    monkeypatch.setattr(nj, "_may_link", spied)
    rows = list(enumerate(_passages(600)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = nj.near_duplicates(df, cross=8).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found) == brute(rows)
    # 11,159 with every pair of blocks that share an n-gram
    assert sum(int(f.name.rpartition("-")[2]) for f in tmp_path.iterdir()) <= 8 * len(rows)


@pytest.mark.parametrize("bounds", [{"BROADCAST": 3, "KEY_BITS": 64}, {"MEET": 4, "AT_ONCE": 50, "COUNTED": 20}])
def test_small_bounds(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(nj, name, value)
    rows = list(enumerate(corpus(5, 90) + _passages(60))) + [(None, "no key here at all"), (7, "w w w w w w w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = nj.near_duplicates(df, few=2, block=8, cross=8, counter_bits=12).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found) == brute(rows)


def test_counters_of_any_size():
    counts = [np.array([0, 1, 255], np.uint32), np.array([0, 70000, 2], np.uint32), np.array([0, 0, 0xFFFFFFFF], np.uint32)]
    assert [len(nj._narrow(c)) for c in counts] == [3, 12, 12]
    batch = pa.record_batch([pa.array([4, 4, 4], pa.int32()), pa.array(map(nj._narrow, counts), pa.binary())], ["chunk", "bits"])
    (found,) = nj._add(3)(iter([batch]))
    assert found["chunk"].to_pylist() == [4] and nj._wide(found["bits"][0].as_py(), 3).tolist() == [0, 70001, 0xFFFFFFFF]


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_rows_of_an_n_gram_in_several_batches(size):
    rows = [(1, 5, 0, 0), (2, 3, 1, 0), (2, 3, 1, 0), (2, 4, 2, 0), (2, 9, 0, 1), (3, 4, 0, 2), (3, 4, 0, 2), (4, 1, 0, 0), (4, 1, 0, 0), (5, 1, 3, 0), (5, 2, 4, 0), (5, 7, 0, 0)]
    kinds = [np.int64, np.int64, np.int32, np.int32]
    batches = (
        pa.record_batch([np.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds)], ["token", "sid", "place", "salt"])
        for i in range(0, len(rows), size)
    )
    found = [tuple(r.values()) for b in nj._several(batches) for r in b.to_pylist()]
    assert found == [(2, 3, 1, 0, 2), (2, 4, 2, 0, 2), (2, 9, 0, 1, 1), (3, 4, 0, 2, 1), (5, 1, 3, 0, 3), (5, 2, 4, 0, 3), (5, 7, 0, 0, 3)]
