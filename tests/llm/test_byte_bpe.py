import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from glotsieve.llm import queries
from glotsieve.llm.byte_bpe import ByteBpe, Merger, encode_documents, merge_piece, read_ranks

PATH = public_tokenizers.path(queries.TOKENIZER)
RANKS = read_ranks(PATH)
MERGER = Merger(RANKS)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(deadline=None, max_examples=150)
@given(st.binary(min_size=1, max_size=60))
def test_pieces(piece):
    assert b"".join(KNOWN.decode_single_token_bytes(i) for i in merge_piece(piece, RANKS)) == piece


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="abcdehilnorst éß日🙂", min_size=1, max_size=40), min_size=1, max_size=30))
def test_many_at_once(pieces):
    got = MERGER.encode(pieces)
    for piece in pieces:
        assert got[piece] == merge_piece(piece.encode(), RANKS) == KNOWN._encode_single_piece(piece)


@pytest.mark.parametrize("piece", ["a" * 5000, "abcabd" * 700, "é" * 999, "thereth" * 300, "x"])
def test_long_pieces(piece):
    assert merge_piece(piece.encode(), RANKS) == KNOWN.encode_ordinary(piece)


def test_documents(spark):
    texts = [None, "", " ", "  \n\t x", "<|endoftext|> I'll", "日本語 ñ🙂 12345", "z" * 20000, "a b " * 20000, "a", "a"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    bpe = ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in encode_documents(df, bpe).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == KNOWN.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
    apart = df.select("doc_id", bpe.decode(bpe.encode(df.text)).alias("decoded")).collect()
    assert {(r.doc_id, bytes(r.decoded)) for r in apart} == {(i, bytes(r.decoded)) for i, r in got.items()}
    assert encode_documents(df.limit(0), bpe).count() == 0
    with pytest.raises(ValueError):
        ByteBpe(spark, PATH, public_tokenizers.PATTERN, max_ranks=10)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op10_byte_bpe(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = KNOWN.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
