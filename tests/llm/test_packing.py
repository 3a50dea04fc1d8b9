"""Ids against the tokenizer, limits of sequences, and odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coverlane.llm import packing

SPEC = packing.tokenizer_spec(public_tokenizers.path(packing.TOKENIZER))
PLAIN = Tokenizer.from_str(SPEC)
PLAIN.encode_special_tokens = True
ENCODE = packing.Encoder(SPEC, most=50)


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAbB.,!?é'sΣσ́ \n\t\x0b  \x1c.!1ßİ漢<|endoftext|>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_match_tokenizer(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    assert packing.word_bounded(SPEC)
    assert not packing.word_bounded(packing.tokenizer_spec(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.mark.parametrize(("tokens", "segments", "loss", "most"), [(64, 8, 64, 90), (64, 3, 40, 30), (50, 50, 10, 20)])
def test_limits_hold_and_every_token_is_placed_once(tokens, segments, loss, most):
    r = np.random.default_rng(5)
    sizes = r.integers(1, most, 400)
    losses = (sizes * r.random(400)).astype(int)
    packer = packing.Packer(tokens, segments, loss, pool=32)
    found = [p for i, (n, k) in enumerate(zip(sizes.tolist(), losses.tolist(), strict=True)) for p in packer.add(i, n, k)] + list(packer.finish())
    place, sequences = defaultdict(list), defaultdict(list)
    for example, start, length, sequence, offset in found:
        place[example].append((start, length))
        sequences[sequence].append((offset, length))
    for i, n in enumerate(sizes.tolist()):
        at = 0
        for start, length in sorted(place[i]):
            assert start == at and length > 0
            at += length
        assert at == n
    for pieces in sequences.values():
        assert len(pieces) <= segments and sum(x for _, x in pieces) <= tokens
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length


def check_rows(rows, texts, spec=PLAIN):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = np.array([*spec.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "Word " * 9000, 3), (4, "Don't  stop\n", 3)], "doc_id long, text string, start int")
    out = packing.pack_documents(docs)
    check_rows(out.collect(), {r.doc_id: r.text for r in docs.collect()})
    assert packing.pack_documents(docs.limit(0)).count() == 0
    twice = packing.pack_documents(docs.unionAll(docs)).groupBy().sum("length").first()[0]
    assert twice == 2 * out.groupBy().sum("length").first()[0]
    one = docs.selectExpr("cast(null as long) doc_id", "text").where("text like 'Don%'")
    row = packing.pack(one, SPEC, 1, with_ids=True).first()
    assert row.doc_id is None and row.ids == [*PLAIN.encode("Don't  stop\n", add_special_tokens=False).ids, 1]


def test_query_matches_tokenizer_with_little_padding(spark):
    from coverlane.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sequences = check_rows(QUERIES["op4_packing"](spark, d).collect(), texts)
    used = sum(x for parts in sequences.values() for _, x in parts)
    assert used > 0.97 * 2048 * len(sequences)
