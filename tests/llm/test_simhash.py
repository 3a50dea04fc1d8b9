"""Fingerprints against a plain loop, links against all pairs, pieces, odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from coverlane.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


def test_fingerprint_matches_plain_loop():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 20, 300]:
        text = " ".join(r.choice(["The", "É", "a\t", "cat\n", "Öl"]) for _ in range(n))
        assert simhash.text_fingerprint(text, 4, 42) == plain_fingerprint(text)
    assert simhash.text_fingerprint(None, 4, 42) == simhash.text_fingerprint(" \n", 4, 42) == 0


def test_every_near_pair_shares_a_key_and_its_chain():
    r = random.Random(2)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randrange(5)):
            b ^= 1 << bit
        pair = np.array([a, b], np.uint64)
        met = {start for start, _, key in simhash._keys(pair, 4) if key[0] == key[1]}
        assert any(len(simhash._near(pair[0], pair[1:], start, 4)) for start in met)


@pytest.mark.parametrize("piece", [20_000, 7])
def test_components_match_all_pairs(spark, piece):
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values[:30] for _ in range(6)]
    values += [values[0] ^ (1 << i) for i in range(64)]  # one dense group
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = spark.createDataFrame([(signed(v),) for v in values + values[:9]] + [(None,)], "fingerprint long")
    want = plain_components(values)
    got = simhash.components(simhash.links(rows, 4, piece), "a", "b").collect()
    comp = {r.node & (2**64 - 1): r.component for r in got}
    for v in want:
        assert comp.get(v, signed(v)) == min(signed(x) for x in want if want[x] == want[v])


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(5, None, 1), (4, "", 1), (9, text, 1), (9, text, 1), (3, text + " end", 1), (None, text, 1), (7, "other words here", 1)],
                                 "doc_id long, text string, fingerprint int")
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.groups(docs).collect()), key=repr)
    assert got == [(-1, 3), (3, 3), (4, 4), (5, 4), (7, 7), (9, 3), (9, 3)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]
    assert simhash.groups(docs.limit(0)).count() == 0 == simhash.deduplicate(docs.limit(0)).count()
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "x")], "doc_id long, text string")
    assert simhash.deduplicate(nulls).count() == 2


def test_query_matches_brute_force(spark):
    from coverlane.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(v) for k, v in texts.items()}
    comp = plain_components(prints.values())
    least = {}
    for k in sorted(prints):
        least.setdefault(comp[prints[k]], k)
    want = sorted((k, f"{prints[k]:016x}", least[comp[prints[k]]]) for k in prints)
    assert sorted(map(tuple, QUERIES["op8_simhash_near_dedup"](spark, d).collect())) == want
