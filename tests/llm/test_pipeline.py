"""Every stage against a plain version of it, on its own input."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from conftest import DATA
from glotsieve.llm import pii_boosting as pb
from glotsieve.llm import queries
from glotsieve.llm.byte_bpe import read_ranks
from test_ngram_jaccard import brute as groups
from test_pii_boosting import brute as base_spans
from test_wu_manber import brute as overlaps

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage was given and returned, as rows, over all documents."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"given": docs.collect()}
    for name, stage in cp.STAGES:
        out[name] = stage(spark, docs, DATA).collect()
        if name != cp.STAGES[-1][0]:
            docs = spark.createDataFrame(out[name], DOCUMENT)
    return out


def test_stages():
    assert [name for name, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]


def test_quality(spark, stages):
    scores = {r.doc_id: r.score for r in queries.op6_quality_cnn(spark, DATA).collect()}
    assert sorted(r.doc_id for r in stages["quality"]) == sorted(r.doc_id for r in stages["given"] if scores[r.doc_id] >= queries.QUALITY)
    assert set(stages["quality"]) <= set(stages["given"])


def test_near_duplicates(stages):
    given = [(r.doc_id, r.text) for r in stages["quality"]]
    leads = {int(k) for k, _, least in groups(given) if int(k) == least}
    assert {r.doc_id for r in stages["near_duplicates"]} == leads
    assert set(stages["near_duplicates"]) <= set(stages["quality"])


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [r for r in stages["near_duplicates"] if not overlaps(r.text, items, 10)[2]]
    assert sorted(stages["decontamination"]) == sorted(clean)


def test_personal_data(stages):
    before = {r.doc_id: r for r in stages["decontamination"]}
    assert len(stages["personal_data"]) == len(before)
    for r in stages["personal_data"]:
        old = before[r.doc_id]
        assert (r.lang, r.source, r.n_chars) == (old.lang, old.source, len(r.text))
        assert not any(base_spans(r.text, kind) for kind in pb.KINDS)
        if not any(base_spans(old.text, kind) for kind in pb.KINDS):
            assert r.text == old.text


def test_tokens(stages):
    ranks = read_ranks(public_tokenizers.path(queries.TOKENIZER))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages["personal_data"]}
    assert len(stages["tokens"]) == len(texts)
    for r in stages["tokens"]:
        assert r.ids == known.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark, stages):
    assert sorted(map(str, cp.run(spark, DATA).collect())) == sorted(map(str, stages["tokens"]))


def test_odd_documents(spark):
    """Null keys and texts, repeated rows and keys, an extra column, and no rows at all."""
    line = "many different words stand in this line of text so that it is fine "
    rows = [(None, None, None, None, None), (None, line, "en", "s", 1), (1, line, "en", "s", 1), (1, line, "en", "s", 1),
            (1, "another text of key one that has no copy anywhere else in here", "en", "s", 1), (2, line + "too", "en", "s", 1),
            (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, None, None, "s", None), (5, "mail me at a@b.example now", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCUMENT + ", sid int")
    kept = cp.near_duplicates(spark, docs, DATA)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "3", "4", "5", "None"]
    unnamed = spark.createDataFrame([(None, line + x, "en", "s", 1) for x in ("", "", "too", "")], DOCUMENT)
    assert cp.near_duplicates(spark, unnamed, DATA).count() == 1
    assert cp.decontamination(spark, docs, DATA).count() == len(rows)
    red = {r.doc_id: r.text for r in cp.personal_data(spark, docs, DATA).collect()}
    assert red[5] == "mail me at [EMAIL] now" and red[4] is None and red[3] == ""
    assert cp.tokens(spark, docs, DATA).count() == len(rows)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
