"""Source divergence: perfect hashes, recount in rounds, the query against its SQL, odd rows."""

import random

import duckdb
import numpy as np
import pytest

from coverlane.llm import divergence


def test_perfect_hash_is_minimal_and_turns_strangers_away():
    r = random.Random(4)
    keys = sorted({"".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(5000)})
    built = divergence.build(keys)
    look = divergence.Lookup(built, offset=7)
    slots = look.slots(keys)
    assert sorted(slots.tolist()) == list(range(7, 7 + len(keys)))
    strangers = [k + "z" for k in keys[:500]]
    assert (look.slots(strangers) == -1).all()
    assert divergence.Lookup(divergence.build([])).slots(["a"]).tolist() == [-1]


def _sql_rows(tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return sorted(tuple(x) for x in con.execute(divergence.CHECK).fetchall())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    got = sorted(tuple(x) for x in divergence.op12_source_divergence(spark, f"/root/testdata/{sf}").collect())
    want = _sql_rows({"documents": f"/root/testdata/{sf}/documents.parquet"})
    assert len(got) > 0 and got == want


def test_small_shards_rounds_and_odd_rows(spark, tmp_path):
    r = random.Random(9)
    words = ["Alpha", "beta", "GAMMA", "délta", "ñu", "x1y", "zeta_eta", "omega", "lambda", "pi", "rho", "sigma"]
    rows = []
    for i in range(160):
        lang = r.choice(["en", "es", None])
        source = r.choice(["s1", "s2", "s3", None]) if i % 7 else "hot"
        text = " ".join(r.choice(words[: 4 + i % 8]) for _ in range(r.randint(0, 30)))
        rows.append((i, text if i % 13 else None, lang, source, 0))
    rows += [rows[3], (500, "", "fr", "only", 0), (501, "word " * 5, "de", "a", 0), (502, "other", "de", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "docs.parquet")
    df.write.parquet(path)
    want = _sql_rows({"documents": path})
    small = divergence.audit(spark.read.parquet(path), shard_keys=3, round_bytes=300, cells=16, block_cells=8)
    got = sorted(tuple(x) for x in small.collect())
    assert got == want
    assert ("de", "a", "pair", "b", 0, 1) in got
    assert not any(x[0] == "fr" for x in got)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(empty).count() == 0


def test_byte_table_gives_the_matches_of_the_pattern():
    import re

    r = random.Random(11)
    pattern = re.compile(divergence.TERM)
    alphabet = "aZ09_ \t\n@[`{~\x7f\x00éÉß中  😀-'"
    for _ in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        lowered = text.translate(str.maketrans(divergence.UPPER, divergence.LOWER))
        assert [t.decode() for t in divergence.terms_of(text.encode())] == pattern.findall(lowered)


def test_counts_are_handed_on_in_small_batches(monkeypatch):
    """A task's counts leave it a few rows at a time, all of them, also with more terms than one batch takes."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "OUT_ROWS", 100)
    words = ["".join(chr(97 + i // 26 ** k % 26) for k in range(3)) for i in range(1000)]
    built = divergence.build([divergence._key("en", w) for w in words])

    class Shared:
        value = {0: divergence.pickle.dumps(built)}

    texts = [" ".join(words[:700]).encode(), " ".join(words[300:]).encode()]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "source": ["a", "a"], "text": texts})
    out = list(divergence._counter(Shared, 1, 1 << 20)(iter([batch])))
    assert len(out) == 10 and max(b.num_rows for b in out) == 100
    assert {r["term"]: r["count"] for b in out for r in b.to_pylist()} == {w: 1 + (300 <= i < 700) for i, w in enumerate(words)}


def test_terms_are_split_a_few_documents_at_a_time(monkeypatch):
    """However many documents a batch has, only a few at a time are held as terms; the counts are those of all."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "DOCS", 3)
    held, real = [], divergence._factorized
    monkeypatch.setattr(divergence, "_factorized", lambda found, docs: held.append(len(found)) or real(found, docs))
    built = divergence.build([divergence._key(lang, "word") for lang in "ab"])

    class Shared:
        value = {0: divergence.pickle.dumps(built)}

    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b"] * 10, "source": ["s"] * 20, "text": [b"word other Word"] * 20})
    out = [r for b in divergence._counter(Shared, 1, 1 << 20)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["lang"], r["term"], r["count"]) for r in out) == [("a", "word", 20), ("b", "word", 20)]
    assert max(held) <= 3
