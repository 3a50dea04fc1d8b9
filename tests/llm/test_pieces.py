"""Segmentations against plain enumeration, whole-text search and the library's decoder; odd rows."""

import random
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from coverlane.llm import pieces

MODEL = pieces.model_file(public_tokenizers.path(pieces.MODEL))
SP = SentencePieceProcessor(model_proto=MODEL)
LATTICE = pieces.Lattice(MODEL, 4)


def enumerate_all(text):
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, len(text) + 1):
        found = LATTICE.pieces.get(text[:k])
        if found:
            out += [(found[0] + s, (found[1], *ids)) for s, ids in enumerate_all(text[k:])]
        elif k == 1:
            own = tuple(LATTICE.byte[b] for b in text[0].encode())
            out += [(LATTICE.unknown + s, own + ids) for s, ids in enumerate_all(text[1:])]
    return out


def unpack(found):
    return [(s, tuple(np.frombuffer(i, "<u4").tolist())) for s, i in found]


@pytest.mark.parametrize("text", ["a", "the", "in the", "a  b", "xyz.\nab", "é▁ß", "the,the", "\n\n", "   ", "漢字 a", "a\r"])
def test_n_best_match_enumeration(text):
    every = sorted(enumerate_all(" " + text), reverse=True)
    found = unpack(LATTICE.encode(text))
    assert np.allclose([s for s, _ in found], [s for s, _ in every[:4]]) and len(set(found)) == len(found)
    assert all(any(i == j and abs(s - t) < 1e-9 for t, j in every) for s, i in found)


def test_segments_match_search_of_the_whole_lattice():
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["the ", "of. ", "ing", "x", " ", "\n", "é,", "  "]) for _ in range(r.randrange(1, 25)))
        whole = LATTICE.search(" " + text)
        assert np.allclose([s for s, _ in unpack(LATTICE.encode(text))], [s for s, _ in whole])


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\r\tathe.,<0x"), st.characters(codec="utf-8")), max_size=40))
def test_round_trip(text):
    for _, ids in unpack(LATTICE.encode(text)):
        if "▁" not in text:
            assert SP.decode(list(ids)) == text


def test_odd_rows_and_decoding(spark):
    texts = [None, "", "a▁b  c\n", "word " * 20000, "one\0two", "same", "same"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, segmentations int")
    out = pieces.encode(docs, MODEL, 2, out_bytes=1000)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].segmentations is None and [tuple(s) for s in rows[1].segmentations] == [(0.0, b"")]
    assert rows[5].segmentations == rows[6].segmentations and len(rows[3].segmentations) == 2
    for k in range(2):
        back = pieces.decode(out.selectExpr("doc_id", "text", f"get(segmentations, {k}).ids as ids"), MODEL)
        assert back.where(f"NOT (decoded <=> text) AND size(array({k})) = 1 AND ids IS NOT NULL").count() == 0
    assert pieces.decode(pieces.encode(docs.limit(0), MODEL).selectExpr("text", "segmentations[0].ids as ids"), MODEL).count() == 0


def test_query_round_trips(spark):
    from coverlane.llm.queries import QUERIES

    out = QUERIES["op9_sentencepiece"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(out) == 1000 and out.round_trip.all() and all(list(s) == sorted(s, reverse=True) for s in out.scores)


def test_pieces_by_characters_hold_every_piece_and_no_other():
    found, todo = {}, [("", LATTICE.follow)]
    while todo:
        text, level = todo.pop()
        for c, (score, piece, more) in level.items():
            found[text + c] = (score, piece) if piece >= 0 else ()
            todo.append((text + c, more))
    assert found == LATTICE.pieces


def test_best_way_and_its_loss_match_the_search():
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(" theingofx,.é漢\n") for _ in range(r.randrange(1, 14)))
        best, loss, ids = LATTICE._best(text)
        found = LATTICE.search(text)
        assert np.isclose(best, found[0][0]) and len(ids) >= 1
        assert len(found) == 1 or np.isclose(loss, found[0][0] - found[1][0])


def odd_texts(seed):
    r = random.Random(seed)
    mixed = ["".join(r.choice(["the ", "qzx", "ing", "of.", " ", "\n", "\0", "é,", "漢", "😀", "".join(r.choices("aeinrst", k=7))]) for _ in range(r.randrange(40))) for _ in range(200)]
    return ["", None, "a" * 300 + " b", *mixed, "\0", "same same", "same same", "".join(r.choices("漢字aeinst.,", k=3000)), "e" * 64, "e" * 65]


@pytest.mark.parametrize(("block", "size"), [(1, 1), (50, 300), (1 << 16, 1 << 19)])
def test_segments_found_together_match_those_searched_one_by_one(block, size):
    lattice = pieces.Lattice(MODEL, 3)
    lattice.block = block
    texts = odd_texts(9)
    found = list(lattice.encode_all(texts, size))
    assert found == [None if t is None else pieces.Lattice.encode(lattice, t) for t in texts]
    assert len(lattice.number) == len(lattice.ids) == len(lattice.texts) > 100
    for text, k in lattice.number.items():
        best, loss, ids = lattice._best(text)
        assert (lattice.texts[k], lattice.best[k], lattice.gap[k], lattice.ids[k]) == (text, best, loss, array("I", ids).tobytes())


def test_texts_with_full_stores_keep_their_results():
    small, large = pieces.Lattice(MODEL, 3, most=2), pieces.Lattice(MODEL, 3)
    assert list(small.encode_all(odd_texts(4), 100)) == list(large.encode_all(odd_texts(4)))


def test_new_words_are_not_searched_one_at_a_time(monkeypatch):
    r, calls, lattice = random.Random(2), [], pieces.Lattice(MODEL, 2)
    texts = [" ".join("".join(r.choices("abcdefghij", k=9)) for _ in range(100)) for _ in range(20)]
    best = lattice._best
    monkeypatch.setattr(lattice, "_best", lambda text: calls.append(text) or best(text))
    for text in texts:
        lattice.encode(text)
    assert len(lattice.words) > 1000 and not calls
