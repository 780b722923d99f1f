import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import DATA
from glotsieve.llm import queries
from glotsieve.llm.wu_manber import LANE, PACK, Patterns, benchmark_overlaps, find, normalise, pattern_tables
from parity import connect, differences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(_UPPER))


def brute(text, items, size):
    doc, hit, found = words(text), set(), set()
    for item, given in items:
        w = words(given)
        if item is None or not w:
            continue
        n = min(size, len(w))
        for win in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}:
            for i in range(len(doc) - n + 1):
                if tuple(doc[i : i + n]) == win:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    spans = []
    for j in sorted(hit):
        if spans and spans[-1][1] == j:
            spans[-1][1] = j + 1
        else:
            spans.append([j, j + 1])
    return len(doc), spans, sorted(found)


@pytest.mark.parametrize("size, part", [(10, 10**6), (3, 60), (1, 10**6)])
def test_against_brute_force(spark, size, part):
    rng = random.Random(size)
    vocabulary = ["a", "b", "ab", "é", "ñandú", "x1", "lengthyword", "日本"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 5, 12, 30]))) for i in range(12)]
    items += [(40, None), (41, ""), (42, "!?"), (None, line(4)), (43, items[3][1]), (9, items[3][1].upper())]
    texts = [None, "", "--", "A-b,AB", *(line(rng.choice([3, 40, 300])) for _ in range(15))]
    texts += [f"{line(9)}. {items[k][1].upper()}! {items[k][1]}{line(2)}" for k in range(12)] * 2
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = benchmark_overlaps(docs, table, size=size, part_bytes=part).collect()
    assert len(found) == len(texts)
    for r in found:
        got = r.n_words, [list(s) for s in r.spans], r["items"]
        assert got == brute(texts[r.doc_id], items, size), r.doc_id


def test_packs_and_lanes():
    """Occurrences across the borders of lanes and packs are found, and none across two texts."""
    rng = random.Random(7)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item = line(12)
    texts = [normalise(item[: len(item) // 2]), normalise(item[len(item) // 2 :]), b""]
    texts += [normalise("x" * k + " " + item) for k in range(0, 2 * LANE, 7)]
    texts += [normalise(line(PACK // 6) + " " + item + " " + line(9)), normalise(item)]
    found = list(find([Patterns([("a", item)]), Patterns([("b", line(30)), ("a", item)])], texts))
    assert len(found) == len(texts) and found[:3] == [([], set())] * 3
    for text, (ranges, items) in zip(texts[3:], found[3:]):
        at = text.index(normalise(item))
        assert ranges == [(at, at + len(item) + 2)] and items == {"a"}


def test_tables_are_compact(spark):
    """About 13 bytes for a byte of item text, in parts of the size asked for; repeated items fill no part."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(10**5)}" for _ in range(60))) for i in range(1000)]
    size = sum(len(t) for _, t in items)
    assert Patterns([(str(i), t) for i, t in items]).nbytes() < 16 * size
    given = spark.createDataFrame(items + [items[0]] * 5000, "item_id long, text string")
    tables, n = pattern_tables(given, "item_id", "text", 10, size // 8, False)
    assert n == size // (size // 8) + 1 and tables.count() == n
    longest = tables.selectExpr("max(octet_length(tables)) AS n").first().n
    assert longest < 16 * 2 * size / n


def test_one_pass_for_many_parts(spark, monkeypatch):
    """Documents are rewritten only for items beyond ``parts`` tables; results do not depend on either."""
    from glotsieve.llm import wu_manber

    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(40)]
    docs = spark.createDataFrame([(i, f"a {items[i][1]} b {items[-i][1]}") for i in range(40)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    written = []
    monkeypatch.setattr(wu_manber, "settle", lambda df, name, inner=wu_manber.settle: written.append(name) or inner(df, name))
    size = sum(len(t) for _, t in items)
    results = []
    for part_bytes, parts in ((10**6, 8), (size // 7, 8), (size // 7, 3)):
        results.append(sorted(map(tuple, benchmark_overlaps(docs, table, part_bytes=part_bytes, parts=parts).collect())))
    assert results[0] == results[1] == results[2] and all(len(r[3]) == min(2, 1 + (r[0] > 0) * (r[0] != 20)) for r in results[0])
    assert written.count("overlaps") == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r[1:] for r in benchmark_overlaps(docs, none).collect()] == [(2, [], [])] * 2
    assert benchmark_overlaps(docs.limit(0), none).count() == 0


def test_items_without_an_id(spark, tmp_path):
    """Their words are hits, as in the SQL, and documents that hold them leave the pipeline."""
    import corpus_pipeline as cp

    lines = [" ".join(f"w{k}x{i}" for i in range(14)) for k in range(4)]
    texts = [f"so {lines[0]} on", lines[1], f"{lines[0]} {lines[2]} {lines[1]}", lines[3], None]
    docs = pa.table({"doc_id": range(5), "text": texts, "lang": ["en"] * 5, "source": ["s"] * 5, "n_chars": [1] * 5})
    items = pa.table({"item_id": pa.array([None, 7, None], pa.int64()), "text": lines[:3]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(items, tmp_path / "benchmark.parquet")
    folder = str(tmp_path)
    rows = {r.doc_id: r for r in queries.op8_wu_manber(spark, folder).collect()}
    assert [(rows[i].n_hit, rows[i].n_items, rows[i].contaminated) for i in range(5)] == [
        (14, 1, True), (14, 1, True), (42, 2, True), (0, 0, False), (0, 0, False)
    ]
    db = connect(folder)
    assert differences(queries.op8_wu_manber(spark, folder), db, queries.SQL["op8_wu_manber"]) is None
    kept = cp.decontamination(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]
    parts = benchmark_overlaps(spark.createDataFrame(docs.to_pandas()), spark.read.parquet(f"{folder}/benchmark.parquet"), part_bytes=60, unnamed=True)
    assert {r.doc_id: len(r["items"]) for r in parts.collect()} == {i: rows[i].n_items for i in range(5)}


def test_queries(spark):
    db = connect(DATA)
    for name in ("op5_url_trie", "op8_wu_manber"):
        assert differences(queries.QUERIES[name](spark, DATA), db, queries.SQL[name]) is None


def test_kept_columns_of_the_results_names(spark):
    docs = spark.createDataFrame([(1, "one two", "s", 5)], "doc_id long, text string, spans string, items int")
    items = spark.createDataFrame([(7, "two")], "item_id long, text string")
    rows = benchmark_overlaps(docs, items, keep=("spans", "items", "text"))
    assert rows.columns == ["doc_id", "kept_spans", "kept_items", "text", "n_words", "spans", "items"]
    (r,) = rows.collect()
    assert (r.kept_spans, r.kept_items, r["items"], [tuple(s) for s in r.spans]) == ("s", 5, ["7"], [(1, 2)])
