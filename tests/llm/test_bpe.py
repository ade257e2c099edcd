import re
from itertools import chain

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
RANKS = bpe.load_ranks()
SPLIT = re.compile(bpe.piece_pattern()).findall
PIECES = bpe.Pieces(RANKS)
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(t):
    return list(chain.from_iterable(map(PIECES.__getitem__, SPLIT(t))))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=80))
def test_any_text(t):
    assert ids(t) == ENC.encode_ordinary(t)


def test_long_piece():
    t = "ab" * 50_000 + "é" * 10_000
    assert ids(t) == ENC.encode_ordinary(t)


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (4, "<|endoftext|>", "k"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {1: ENC.encode_ordinary("Hello world"), 2: [], 3: [], 4: ENC.encode_ordinary("<|endoftext|>")}
    n = {r.doc_id: (r.k, r.n_tokens) for r in bpe.token_counts(df.withColumnRenamed("ids", "k"), keep=("k",)).collect()}
    assert n == {1: ("x", 2), 2: ("y", 0), 3: ("z", 0), 4: ("k", len(got[4]))}
    assert bpe.encode(df.limit(0)).count() == 0


def test_round_trip(spark, sf):
    from palimpsest.session import table

    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = bpe.encode(table(spark, sf, "documents")).collect()
    assert len(rows) == len(texts)
    assert all(ENC.decode(list(r.ids)) == (texts[r.doc_id] or "") for r in rows)
