import random

import numpy as np
import pytest

from conftest import DATA
from glotsieve.llm import induced_sorting, queries
from glotsieve.llm import suffix_dedup as sd
from parity import connect, differences


def test_suffix_array(monkeypatch):
    rng = np.random.default_rng(0)
    for size in (4, 1 << 13):
        monkeypatch.setattr(induced_sorting, "RANGE", size)
        monkeypatch.setattr(induced_sorting._ranges, "__defaults__", (size,))
        for trial in range(500):
            symbols = int(rng.integers(1, 5))
            text = rng.integers(0, symbols, rng.integers(0, 40))
            if trial % 3 == 0 and len(text):
                text = np.tile(text, 3)
            given = text.tolist()
            order = induced_sorting.suffix_array(text, symbols).tolist()
            assert order == sorted(range(len(given)), key=lambda i: given[i:])
            common = induced_sorting.common_prefixes(text, np.array(order, np.int64))
            for a, b in zip(order[1:], order):
                same = 0
                while max(a, b) + same < len(given) and given[a + same] == given[b + same]:
                    same += 1
                assert common[a] == same


def test_gram_hashes_tell_grams_apart():
    data = np.frombuffer(random.Random(1).randbytes(3000) + b"ab" * 50, np.uint8)
    for size in (1, 7, 20, 50):
        hashes = sd.Grams(data).at(size)
        grams = [data[i : i + size].tobytes() for i in range(len(data) - size + 1)]
        assert len(hashes) == len(grams) and len(set(zip(grams, hashes.tolist()))) == len(set(grams)) == len(set(hashes.tolist()))
        some = np.arange(0, len(grams), 7)
        assert (sd.Grams(data).at(size, some) == hashes[some]).all()


@pytest.mark.parametrize("longer", [None, 20, 40, 50])
def test_pieces_cover_all_passages_once(longer):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc ", k=k)).encode() for k in (50, 51, 400, 60)] + [b"short", b"ab" * 200, b"", b"a" * 300]
    pieces = sd.Pieces(texts, 50, 20)
    every = np.arange(len(pieces.at))
    if longer:
        pieces = pieces.finer(every, longer)
        every = np.arange(len(pieces.at))
    owner = pieces.owners(every)
    place = pieces.at - pieces.starts[owner]
    seen = [(o, p + j) for o, p, n in zip(owner.tolist(), place.tolist(), pieces.count.tolist()) for j in range(n)]
    assert sorted(seen) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 49)]
    data = pieces.bytes_of(every).to_pylist()
    keys = {}
    for o, p, n, key, content, d in zip(*(x.tolist() for x in (owner, place, pieces.count, pieces.key, pieces.content(every))), data):
        assert d == texts[o][p : p + n + 49]
        assert keys.setdefault(content, d) == d
        for j in range(n):  # equal passages have equal grams
            assert keys.setdefault(("gram", d[j : j + 50]), key) == key


def brute(rows, length):
    """(key, bytes, spans, kept) of every (key, text)."""
    least = {}
    for key, text in rows:
        data = (text or "").encode()
        if key is not None:
            for i in range(len(data) - length + 1):
                s = data[i : i + length]
                least[s] = min(key, least.get(s, key))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if key is not None:
            for i in range(len(data) - length + 1):
                if least[data[i : i + length]] < key:
                    gone[i : i + length] = b"\1" * length
        edges = [i for i in range(len(data) + 1) if (gone[i] if i < len(data) else 0) != (gone[i - 1] if i else 0)]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((str(key), len(data), tuple(zip(edges[::2], edges[1::2])), kept))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéñ漢", k=rng.randint(1, 7))) for _ in range(60)]
    line = lambda k: " ".join(rng.choices(words, k=k))
    common = [line(20) for _ in range(3)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.5 and texts:
            old = rng.choice(texts)
            a = rng.randint(0, len(old))
            texts.append(old[:a] + line(2) + old[a : a + rng.randint(0, 300)])
        else:
            texts.append(line(rng.choice([1, 8, 30, 60])) + rng.choice(common) * rng.randint(0, 2) + line(3))
    return texts


def result(df, **options):
    found = sd.remove_repeats(df, **options).collect()
    return sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in found)


@pytest.mark.parametrize("length, gram, often", [(50, 20, 2048), (50, 20, 9), (12, 5, 3), (7, 7, 2048)])
def test_against_brute_force(spark, monkeypatch, length, gram, often):
    monkeypatch.setattr(sd, "OFTEN", often)
    monkeypatch.setattr(sd, "LOCAL", 1)
    monkeypatch.setattr(sd, "BUCKET", 1 << 12)
    monkeypatch.setattr(sd, "SHARD", 1 << 12)
    monkeypatch.setattr(sd, "BROADCAST", 20 if often == 9 else 300_000)
    texts = corpus(length, 90) + [None, "", "x", "w " * 900, "w " * 400, "a" * 500, "ab" * 99 + "a" * 99]
    rows = [(i * 37 % 211 - 50, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (rows[1][0], texts[5]), (None, texts[2]), (None, texts[2] + "new"), (None, None)]
    df = spark.createDataFrame([(t, k, b"n", 1) for k, t in rows], "text string, doc_id long, data binary, key int")
    assert result(df.repartition(4), length=length, gram=gram) == brute(rows, length)


def test_long_text_in_packs(spark, monkeypatch):
    monkeypatch.setattr(sd, "PACK", 500)
    texts = corpus(5, 12)
    rows = [(9, "".join(texts)), (3, "".join(texts[3:6])), (4, "z".join(texts[::-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows, 50)


def test_empty(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []
    df = spark.createDataFrame([(1, None), (2, "short"), (None, "y" * 60)], "doc_id long, text string")
    assert result(df) == brute([(1, None), (2, "short"), (None, "y" * 60)], 50)


def test_query(spark):
    name = "op11_suffix_dedup"
    assert differences(queries.QUERIES[name](spark, DATA), connect(DATA), queries.SQL[name]) is None


def test_grams_are_handed_over_before_they_are_many():
    import numpy as np
    import pyarrow as pa
    from types import SimpleNamespace

    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 1 << 16))) for _ in range(160)]
    batch = pa.record_batch([pa.array(texts), pa.array(range(160), pa.int64())], ["text", "key"])
    run = sd._grams(SimpleNamespace(value=np.empty(0, np.uint64)), sd.LENGTH, sd.GRAM, 4)
    assert sum(1 for _ in run([batch])) > 1
