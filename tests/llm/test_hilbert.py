import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from glotsieve.llm import queries
from glotsieve.llm.hilbert import curve_index, hilbert_shards, read_shards, string_borders, write_shards


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 1), (2, 5), (3, 3), (4, 2)])
def test_curve_visits_neighbours(n, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    order = points[np.argsort(curve_index(points, bits))]
    assert sorted(curve_index(points, bits)) == list(range(len(points)))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def check(rows, shards):
    n = len(rows)
    counts = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    by_shard = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in by_shard] == sorted(r.curve for r in rows)


def test_cases(spark):
    texts = [None, "", "ñ🙂", "a" * 50000, "same", "same"] + ["hot"] * 40
    rows = [(i // 2, t, None if i == 3 else "src", ["en", None][i % 2], 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, slot int")
    got = hilbert_shards(df, shards=7).collect()
    check(got, 7)
    assert sorted((r.doc_id, r.size, r.text_crc32 or 0) for r in got) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    again = hilbert_shards(df.repartition(5), shards=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    check(hilbert_shards(df.limit(3), shards=7).collect(), 7)
    assert hilbert_shards(df.limit(0), shards=7).count() == 0
    check(hilbert_shards(df, dimensions=("slot", "doc_id"), shards=4).collect(), 4)


def test_pruning(spark):
    """A filter on any dimension meets fewer shards than a random order would."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hilbert_shards(docs).collect()
    check(rows, 16)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for name in ("de", "fr", "es"):
        assert len({r.shard for r in rows if lang[r.doc_id] == name}) <= 10


def test_query(spark):
    rows = queries.op2_hilbert_shards(spark, DATA).collect()
    assert len(rows) == 200 and {r.law for r in rows} == {"rows"}
    assert {r.grown_shard for r in rows} == {None}


def test_files_by_shard_are_skipped(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).withColumn("lang", F.expr("nullif(lang, 'es')"))  # repeated and missing values
    path = f"file://{tmp_path}/shards"
    write_shards(docs, path, files=32)
    back = spark.read.parquet(f"{path}/rows")
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    counts = [r["count"] for r in back.groupBy("_shard").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1
    source = docs.agg(F.min("source")).first()[0]
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0]
    for wanted, condition in [
        ({"lang": ("de", "de")}, "lang = 'de'"), ({"lang": None}, "lang is null"), ({"source": (source, source)}, f"source = '{source}'"),
        ({"_size": (longest // 2, longest + 1)}, f"octet_length(text) + 1 between {longest // 2} and {longest + 1}"),
        ({"lang": ("fr", "fr"), "_size": (1, 500)}, "lang = 'fr' and octet_length(text) + 1 <= 500"),
    ]:
        rows, read, skipped = read_shards(spark, path, **wanted)
        assert rows.count() == docs.filter(condition).count()
        assert skipped > 0 and read + skipped >= 16, (wanted, read, skipped)
    rows, read, _ = read_shards(spark, path, lang=("xx", "xx"))
    assert (rows.count(), read) == (0, 0)


def test_clashing_names_are_refused(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    with pytest.raises(ValueError):
        write_shards(docs.withColumn("_slot", F.lit(1)), f"file://{tmp_path}/refused")


def test_strings_of_a_long_common_beginning_are_told_apart(spark):
    rows = [(i, "x" * (i % 50), f"https://host.example/a/{i % 64:04}" if i % 9 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string")
    got = hilbert_shards(df, dimensions=("url", "_size")).collect()
    check(got, 16)
    url = {i: u for i, _, u in rows}
    for wanted in ("https://host.example/a/0003", "https://host.example/a/0060", None):
        assert len({r.shard for r in got if url[r.doc_id] == wanted}) <= 6, wanted


def test_string_borders_are_exact(spark):
    values = ["hot"] * 700 + [f"a{i:03}" for i in range(200)] + ["é🙂", ""] + [None] * 98
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(9)
    shares = [i / 32 for i in range(1, 32)]
    ordered = sorted(values, key=lambda v: (v is not None, (v or "").encode()))
    expected = [ordered[int(s * len(values))] or "" for s in shares]
    assert string_borders(df, "v", shares) == expected
    assert string_borders(df.limit(0), "v", shares) == []
