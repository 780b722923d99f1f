import pytest

from glotsieve.operators import dataset as ds
from glotsieve.operators import labels as lb
from glotsieve.operators import sampling as sm
from glotsieve.session import attach, settle
from glotsieve.sources import texts as st
from glotsieve.values import LABEL_ALIASES
from pyspark.sql import functions as F


def test_relabelled_treats_two_missing_labels_as_equal(spark):
    rows = [(1, "a", "a"), (2, "a", "b"), (3, None, None), (4, None, "b")]
    df = spark.createDataFrame(rows, "key LONG, original_language STRING, language STRING")
    assert sorted(r.key for r in ds.relabelled_rows(df).collect()) == [2, 4]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("x", 1)], "text STRING, n INT")
    b = ds.add_source(spark.createDataFrame([("y",)], "text STRING"), "b")
    assert sorted(map(tuple, ds.union_sources(a, b).collect())) == [("x", 1, None), ("y", None, "b")]


def test_dedup_keeps_the_smallest_key_and_counts_what_it_drops(spark):
    rows = [(3, "a"), (1, "a"), (2, "b"), (4, "a")]
    df = spark.createDataFrame(rows, "key LONG, text STRING")
    assert sorted(r.key for r in ds.dedup_rows(df, "key").collect()) == [1, 2]
    assert ds.count_removed(df, ["text"]).first().removed == 2


def test_labels(spark):
    rows = [(i, c) for i, c in enumerate(["en", "el", "zz", None, "sw", "eng"])]
    df = spark.createDataFrame(rows, "key LONG, language STRING")
    named = {r.key: r.language for r in lb.iso639_1_to_language(df, "language", "key").collect()}
    assert named == {
        0: "English", 1: "Modern Greek (1453-)", 2: "unknown", 3: "unknown",
        4: "Swahili (macrolanguage)", 5: "unknown",
    }
    rows = [(i, c) for i, c in enumerate(["pes", "cmn", "en"])]
    df = spark.createDataFrame(rows, "key LONG, language STRING")
    named = lb.iso639_3_to_language(df, "language", "key")
    standard = named.withColumn("language", lb.replace_language("language")).orderBy("key")
    assert [r.language for r in standard.collect()] == ["Persian", "Chinese", "unknown"]
    for spelling, label in LABEL_ALIASES.items():
        row = spark.range(1).select(lb.replace_language(F.lit(spelling)).alias("x")).first()
        assert row.x == label


def test_drop_rarest_drops_one_class(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [("c",)], "language STRING")
    assert {r.language for r in lb.drop_rarest_language(df).collect()} == {"a", "c"}


def _population(spark, n=3000):
    # One class holds nine tenths of the rows.
    language = F.when(F.col("id") % 10 == 0, "small").otherwise("hot")
    return spark.range(n).select(F.col("id").alias("key"), language.alias("language"))


def test_split_is_exact_by_group_and_indifferent_to_partitioning(spark):
    df = _population(spark, 1234)
    split = sm.split_train_test(df, "key", "language")
    counts = {(r.language, r.split): r["count"] for r in split.groupBy("language", "split").count().collect()}
    for language, n in (("hot", 1110), ("small", 124)):
        assert counts[language, "train"] == round(0.8 * n)
        assert counts[language, "test"] == n - round(0.8 * n)
    again = sm.split_train_test(df.repartition(13), "key", "language")
    assert split.exceptAll(again).isEmpty()


def test_split_ranks_by_hash(spark):
    import hashlib

    df = _population(spark, 500)
    split = {r.key: r.split for r in sm.split_train_test(df, "key", "language").collect()}
    for rest in (lambda k: k % 10 == 0, lambda k: k % 10 != 0):
        keys = sorted(
            (k for k in range(500) if rest(k)), key=lambda k: hashlib.md5(f"1:{k}".encode()).hexdigest()
        )
        test = len(keys) - round(0.8 * len(keys))
        assert {k for k in keys if split[k] == "test"} == set(keys[:test])


def test_sample_is_exact_and_complements_the_unseen(spark):
    df = _population(spark)
    quotas = spark.createDataFrame([("hot", 700), ("small", 300)], "language STRING, quota INT")
    sample = sm.sample_per_language(df, "key", quotas)
    assert {r.language: r["count"] for r in sample.groupBy("language").count().collect()} == {
        "hot": 700, "small": 300,
    }
    unseen = sm.unseen_rows(df, sample, "key")
    assert sample.unionByName(unseen).exceptAll(df).isEmpty()
    assert unseen.count() + sample.count() == df.count()


@pytest.mark.parametrize("quotas", [[("hot", 10)], [("hot", 10), ("small", 301)]])
def test_short_or_missing_quota_is_an_error_unless_lenient(spark, quotas):
    df = _population(spark)
    table = spark.createDataFrame(quotas, "language STRING, quota INT")
    with pytest.raises(sm.ShortGroup):
        sm.flag_sampled(df, "key", table)
    taken = sm.sample_per_language(df, "key", table, strict=False).groupBy("language").count()
    expected = {"hot": 10} if len(quotas) == 1 else {"hot": 10, "small": 300}
    assert {r.language: r["count"] for r in taken.collect()} == expected


@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_sample_n(spark, n):
    df = _population(spark, 400)
    assert sm.sample_n(df, "key", n).count() == min(n, 400)


def test_lookup_beyond_its_bound_is_joined_by_salt(spark):
    big = _population(spark, 300)
    small = settle(
        spark.createDataFrame([("hot", 1), ("small", 2), ("other", 3)], "language STRING, id INT"),
        "lookup",
    )
    plain = attach(big, small, "language", spread_by="key")
    salted = attach(big, small, "language", spread_by="key", max_rows=2, salts=4)
    assert salted.count() == 300
    assert plain.select(salted.columns).exceptAll(salted).isEmpty()


def test_sources_and_sinks(spark, tmp_path):
    rows = [(1, 'say ""hi""\nthere', "en", "train"), (2, "b, c", "fr", "test")]
    df = spark.createDataFrame(rows, "key LONG, text STRING, language STRING, split STRING")
    csv = str(tmp_path / "csv")
    df.select("text", "language").write.csv(csv, header=True, quote='"', escape='"')
    read = st.scan_texts(spark, csv, "csv")
    assert sorted(map(tuple, read.collect())) == sorted((r[1], r[2]) for r in rows)
    st.write_dataset(df, str(tmp_path / "set"))
    back = spark.read.parquet(str(tmp_path / "set")).select(df.columns)
    assert back.exceptAll(df).isEmpty() and back.count() == 2
    assert (tmp_path / "set" / "split=train").exists()
    st.write_unseen(df.withColumn("sampled", F.expr("nullif(key, 2) is not null")), str(tmp_path / "unseen"))
    assert [r.key for r in spark.read.parquet(str(tmp_path / "unseen")).collect()] == [2]
    st.write_corpus(df, str(tmp_path / "corpus"), "test")
    assert [r.value for r in spark.read.text(str(tmp_path / "corpus")).collect()] == ["b, c"]


def test_rows_without_label_or_source_stay(spark):
    rows = [(i, None if i % 4 == 0 else "remove" if i % 4 == 1 else "en", None if i < 20 else "s") for i in range(40)]
    df = spark.createDataFrame(rows, "key LONG, language STRING, source STRING")
    assert ds.filter_removed(df).count() == 30
    split = sm.split_train_test(df, "key").groupBy("source", "split").count().collect()
    assert sorted((str(r.source), r.split, r["count"]) for r in split) == [
        ("None", "test", 4), ("None", "train", 16), ("s", "test", 4), ("s", "train", 16)
    ]
    few = spark.createDataFrame([("a",), ("a",), (None,), ("b",), ("b",), ("b",)], "language STRING")
    assert sorted(str(r.language) for r in lb.drop_rarest_language(few).collect()) == ["None", "b", "b", "b"]


@pytest.mark.parametrize("k", [1, 7, 99, 100, 150, 500])
def test_largest_rows_are_the_top_k(spark, k):
    from glotsieve.operators.topk import largest_rows

    rows = [(f"w{i:03d}", 1 + (i * 37) % 50 if i < 100 else 1) for i in range(300)]
    df = spark.createDataFrame(rows, "word STRING, n LONG")
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
    assert sorted(map(tuple, largest_rows(df, "n", "word", k).collect())) == sorted(expected)
