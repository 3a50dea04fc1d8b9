"""Byte-level BPE: parts give the ids of the whole text, round trips, odd rows, the query against plain tiktoken."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from coverlane.llm import bytebpe

RANKS = P.path("byte_bpe_50k.tiktoken")


def enc():
    return bytebpe.encoding(RANKS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab Z9\n\t.'s é中\x1c") + ["\r\n", "  ", "'ll", "1 "]), max_size=200).map("".join),
       st.integers(min_value=4, max_value=60))
def test_parts_give_the_ids_of_the_whole_text(text, size):
    assert "".join(bytebpe.parts(text, size)) == text
    assert bytebpe.encode_text(enc(), text, size) == enc().encode_ordinary(text)


def test_long_texts_and_no_safe_place():
    r = random.Random(3)
    words = ["alpha", "beta", "  ", "\n\n", "x1", "中文", "!!", "'re", "  \t"]
    long = " ".join(r.choice(words) for _ in range(60_000))
    pieces = bytebpe.parts(long)
    assert len(pieces) > 2 and "".join(pieces) == long
    assert bytebpe.encode_text(enc(), long) == enc().encode_ordinary(long)
    blank = " " * 200_000 + "z"
    assert bytebpe.parts(blank) == [blank]
    assert bytebpe.encode_text(enc(), blank) == enc().encode_ordinary(blank)


def test_operator_odd_rows_and_round_trip(spark):
    texts = [(1, "Hello world <|endoftext|> ok", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world <|endoftext|> ok", "x"),
             (4, "ünï  cödé\n\n\tend 123 4567", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, ids string")
    got = bytebpe.encode(df, RANKS, P.PATTERN, size=8).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [1, 1, 2, 3, 4]
    for r in got:
        text = dict((a, b) for a, b, _ in texts)[r.doc_id] or ""
        assert list(r.ids) == enc().encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bytebpe.encode(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).count() == 0


def test_query_against_plain_tiktoken(spark):
    got = {r.doc_id: r for r in bytebpe.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = enc().encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
