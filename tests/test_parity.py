"""Registered queries against their SQL. ``python tests/parity.py`` runs all."""

import pytest

from conftest import DATA
from parity import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from glotsieve.plans.queries import QUERIES

CHOSEN = [
    "union_sources", "dedup_first", "split_train_test", "flag_sampled", "clean_text", "tokenize",
    "nb_scores", "nb_predict", "count_blocks", "unique_chars", "train_ngrams", "closest_distance",
    "stage_comparison", "nb_tune_alpha", "unicode_tune_margin", "detect_scripts", "build_dataset",
]


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, db, name):
    assert differences(queries()[name](spark, DATA), db, oracle_sql()[name]) is None


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    untold = set(QUERIES) - set(oracle_sql())
    assert untold == {"train_tokenizer", "tokenize_subwords", "token_pieces", "detect_subwords"}


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "source", "language", "predicted_language"]
