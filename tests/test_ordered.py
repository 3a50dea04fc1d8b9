"""Operators along a key give the same rows whether or not a key was cut into slices."""

import random

import pytest
from pyspark.sql import functions as F

from coverlane.operators import catalog, navigation, ordered


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaab"), rng.randrange(400), i, rng.choice("xyz"), rng.random() < 0.3) for i in range(600)]
    return spark.createDataFrame(rows, "k string, t long, id long, v string, hit boolean").repartition(5).cache()


def by(hot_rows):
    return ordered.Ordering(("k",), ("t", "id"), F.floor(F.col("t") / 7), hot_rows)


def history(log):
    keys = {}
    for r in sorted(log.collect(), key=lambda r: (r["k"], r["t"], r["id"])):
        keys.setdefault(r["k"], []).append(r)
    return keys


@pytest.mark.parametrize("hot_rows", [10**9, 50])
def test_against_plain_loops(log, rows, hot_rows):
    cut = ordered.cut_hot(log, by(hot_rows))
    prev, total, last, ahead = [], [], [], []
    for key, items in history(log).items():
        count, seen = 0, None
        for i, r in enumerate(items):
            prev.append((r["id"], items[i - 1]["v"] if i else None))
            count += r["hit"]
            seen = r["id"] if r["hit"] else seen
            total.append((r["id"], count))
            last.append((r["id"], seen))
            ahead.append((r["id"], next((n["id"] for n in items[i + 1:] if n["hit"]), None)))
    assert rows(ordered.previous(cut, F.col("v"), "o").df, "id", "o") == sorted(prev, key=repr)
    assert rows(ordered.running_total(cut, F.col("hit").cast("long"), "o").df, "id", "o") == sorted(total, key=repr)
    assert rows(ordered.last_seen(cut, F.col("id"), F.col("hit"), "o").df, "id", "o") == sorted(last, key=repr)
    assert rows(ordered.next_seen(cut, F.col("id"), F.col("hit"), "o").df, "id", "o") == sorted(ahead, key=repr)


def test_longest_runs(log, rows):
    expected = []
    for key, items in history(log).items():
        best = run = 0
        for r in items:
            run = run + 1 if r["hit"] else 0
            best = max(best, run)
        expected.append((key, best))
    for hot_rows in (10**9, 50):
        assert rows(ordered.longest_runs(ordered.cut_hot(log, by(hot_rows)), F.col("hit"))) == sorted(expected)


def test_changes_on_hot_keys(log, rows):
    plain, cut = (navigation.changes(log, by(h), F.col("v")).select("id", "prev_value") for h in (10**9, 50))
    assert rows(plain) == rows(cut)


def test_pages_keep_every_child(log, rows):
    item = F.struct("id")
    got = [catalog.pages(log, "k", ("t", "id"), item, F.floor(F.col("t") / 7), page_size=40, hot_rows=h).collect() for h in (10**9, 50)]
    for pages in got:
        assert max(len(p["items"]) for p in pages) == 40
        for key, items in history(log).items():
            ordered_ids = [x["id"] for p in sorted((p for p in pages if p["k"] == key), key=lambda p: p["page"]) for x in p["items"]]
            assert ordered_ids == [r["id"] for r in items]


def test_key_values_and_first_change(log, rows):
    tests, flags = [("v", "value")], [(F.col("hit"), "hit")]
    expected = []
    for key, items in history(log).items():
        first = items[0]
        reason = ((r["id"], "value" if r["v"] != first["v"] else "hit") for r in items[1:] if r["v"] != first["v"] or r["hit"])
        expected += [(key, *hit) for hit in [next(reason, None)] if hit]
    for hot_rows in (10**9, 50):
        assert rows(navigation.first_change(log, by(hot_rows), tests, flags), "k", "id", "reason") == sorted(expected)
        size = ordered.of_key(ordered.cut_hot(log, by(hot_rows)), F.count("*"), "n").df
        assert rows(size.select("k", "n").distinct()) == sorted((k, len(v)) for k, v in history(log).items())
        assert size.count() == 600


def test_null_keys_and_null_order_values(spark, rows):
    """As plain windows give it, cut or not."""
    data = [(k, t, i) for i, (k, t) in enumerate([(k, t) for k in ("a", None) for t in (None, None, None, None, 1, 2, 3, 8, 9, 15, 16, 30)])]
    df = spark.createDataFrame(data, "k string, t long, id long")
    want_prev, want_pos = [], []
    for key in ("a", None):
        items = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want_prev += [(r[2], items[i - 1][2] if i else None) for i, r in enumerate(items)]
        want_pos += [(r[2], i + 1) for i, r in enumerate(items)]
    for hot_rows in (10**9, 5):
        cut = ordered.cut_hot(df, by(hot_rows))
        assert rows(ordered.previous(cut, F.col("id"), "o").df, "id", "o") == sorted(want_prev, key=repr)
        assert rows(ordered.row_position(cut, "o").df, "id", "o") == sorted(want_pos, key=repr)
        assert ordered.of_key(cut, F.count("*"), "n").df.where("n = 12").count() == 24
