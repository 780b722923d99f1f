"""Times the headline queries and prints one JSON line.

Queries train what they need on the documents. ``train_detector`` and
``label_documents`` time the two halves of detection apart: the second labels
all documents with a detector that is at hand.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (names by comma) may be set.
"""

from __future__ import annotations

import json
import os
import time

from glotsieve.plans import detect
from glotsieve.plans.queries import KEY, QUERIES, documents, labelled
from glotsieve.session import build_session, clear_scratch

HEADLINE = [
    "clean_text",
    "dedup_rows",
    "split_train_test",
    "sample_n",
    "word_vocabulary",
    "tokenize",
    "nb_fit",
    "nb_predict",
    "highest_block",
    "train_ngrams",
    "ngram_distance",
    "unicode_predict",
    "stage_comparison",
    "nb_tune_alpha",
    "train_tokenizer",
    "detect_language",
    "detect_unlabelled",
]
TRAIN, LABEL = "train_detector", "label_documents"


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["clean_text"](spark, sf).count()  # start the JVM's engines
    seconds = {}
    chosen = names.split(",") if names else [*HEADLINE, TRAIN, LABEL]
    if TRAIN in chosen or LABEL in chosen:
        start = time.perf_counter()
        detector = detect.train_detector(labelled(spark, sf).filter("split = 'train'"), tokens="word")
        seconds[TRAIN] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        found = detect.detect_labels(documents(spark, sf), "text", KEY, detector)
        found.write.format("noop").mode("overwrite").save()
        seconds[LABEL] = round(time.perf_counter() - start, 3)
    for name in chosen:
        if name in seconds:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
