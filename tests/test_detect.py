import pytest

from glotsieve.plans import detect as dt
from glotsieve.plans.queries import in_scripts
from glotsieve.streaming.detect import detect_stream
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def detector(docs):
    return dt.train_detector(docs.filter("split = 'train'"), tokens="word")


@pytest.fixture(scope="module")
def test_rows(docs):
    return docs.filter("split = 'test'").select("doc_id", "text", "language")


def _labels(df):
    return {r.doc_id: r.predicted_language for r in df.collect()}


def test_all_columns_and_rows_come_back(test_rows, detector):
    found = dt.detect_language(test_rows, "text", detector)
    assert found.columns == [*test_rows.columns, "predicted_language"]
    assert found.drop("predicted_language").exceptAll(test_rows).isEmpty()
    assert found.count() == test_rows.count()
    right = found.filter("predicted_language = language").count()
    assert right / found.count() > 0.9


def test_labels_do_not_depend_on_partitioning_or_null_texts(spark, test_rows, detector):
    a = _labels(dt.detect_language(test_rows, "text", detector))
    b = _labels(dt.detect_language(test_rows.repartition(7), "text", detector))
    assert a == b
    extra = spark.createDataFrame([(-1, None, None), (-2, "", None)], "doc_id LONG, text STRING, language STRING")
    c = _labels(dt.detect_language(test_rows.union(extra), "text", detector))
    assert {k: v for k, v in c.items() if k >= 0} == a
    assert c[-1] == c[-2] == "UNKNOWN"


def test_the_rule_only_adds_labels(test_rows, detector):
    from dataclasses import replace

    strict = replace(detector, threshold=1.0)
    found = dt.detect_labels(test_rows, "text", "doc_id", strict)
    assert found.filter("predicted_language <> 'UNKNOWN'").count() > 0.8 * test_rows.count()


def test_scripts(docs):
    texts = in_scripts(docs)
    detector = dt.train_detector(texts.filter("split = 'train'"), tokens="word", threshold=1.0)
    found = dt.detect_language(texts, "text", detector)
    seen = {r.predicted_language for r in found.select("predicted_language").distinct().collect()}
    assert {"English", "Greek", "Thai", "Hindi", "Korean", "Vietnamese", "UNKNOWN"} & seen >= {
        "English", "Greek", "Thai", "Hindi"
    }


@pytest.mark.parametrize("tokens", ["word", "subword"])
def test_saved_detector_gives_the_same_labels(spark, docs, test_rows, tmp_path, tokens):
    trained = dt.train_detector(docs.filter("split = 'train'"), tokens=tokens, size=800)
    dt.save_detector(trained, str(tmp_path / "model"))
    loaded = dt.load_detector(spark, str(tmp_path / "model"))
    assert _labels(dt.detect_labels(test_rows, "text", "doc_id", trained)) == _labels(
        dt.detect_labels(test_rows, "text", "doc_id", loaded)
    )


SMOKE = {
    "English": "Every morning the baker opens her window and whistles to the birds of the street",
    "Chinese": "明天早上我们去公园看花然后回家吃饭",
    "Spanish": "Mañana el niño pequeño le enseñará a su dueño la araña del baño",
    "Thai": "พรุ่งนี้เช้าเราจะไปเดินเล่นที่ตลาดริมแม่น้ำ",
    "Arabic": "في الصباح نذهب إلى السوق ونشتري الخبز والفاكهة لجدتي",
    "Hindi": "कल सुबह हम नदी के किनारे टहलने जाएंगे और चाय पिएंगे",
    "Korean": "내일 아침에 우리는 강가를 걷고 나서 따뜻한 차를 마실 것이다",
}


def test_seven_languages_without_a_key(spark, detector):
    from dataclasses import replace

    rows = spark.createDataFrame(list(SMOKE.items()), "language STRING, raw STRING")
    found = dt.detect_language(rows, "raw", replace(detector, threshold=1.0))
    assert found.columns == ["language", "raw", "predicted_language"]
    assert {r.language: r.predicted_language for r in found.collect()} == {x: x for x in SMOKE}


def test_null_and_equal_keys(spark, test_rows, detector):
    """Rows keep their number and order of labels whatever their keys are."""
    some = test_rows.limit(20).collect()
    alone = {r.text: dt.detect_labels(spark.createDataFrame([r]), "text", "doc_id", detector).first()[1] for r in some[:3]}
    keys = [None, 1, 1, None, 2]
    rows = [(k, some[i % 3].text) for i, k in enumerate(keys)]
    given = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = dt.detect_labels(given, "text", "doc_id", detector).collect()
    assert sorted((str(r.doc_id), r.predicted_language) for r in found) == sorted((str(k), alone[t]) for k, t in rows)


def _final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_texts_are_exchanged_once(test_rows, detector):
    plan = _final_plan(dt.label_texts(test_rows, "text", detector))
    by_text = [x for x in plan.splitlines() if "Exchange" in x and "hashpartitioning(_digest" in x]
    # texts once, and the narrow rows of those left unknown
    assert sum("ReusedExchange" not in x for x in by_text) == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_stream(spark, test_rows, detector, tmp_path):
    source = str(tmp_path / "in")
    test_rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(test_rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    writer = detect_stream(stream, "text", detector, str(tmp_path / "out"))
    query = (
        writer.option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select("batch").distinct().count() == 2
    assert _labels(found) == _labels(dt.detect_language(test_rows, "text", detector))
    assert found.filter(F.col("predicted_language").isNull()).isEmpty()
