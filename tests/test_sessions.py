import random

import pytest

from coverlane.operators import sessions

SCHEMA = "name string, t bigint, seq bigint, opens boolean, closes boolean, reset boolean"
SECOND = 1_000_000


def walk(rows, ttl):
    """The rules, one row at a time."""
    out, login, current = [], None, None
    for name, t, seq, opens, closes, reset in sorted(rows):
        if name != current:
            current, login = name, None
        if reset:
            phase, used, login = "reset", None, None
        elif login is None:
            phase, login = ("login", (t, seq)) if opens else ("none", None)
            used = login
        elif closes and t - login[0] > ttl * SECOND:
            phase, used, login = "late", login, None
        else:
            phase, used = "live", login
        out.append((name, t, seq, phase, *(used or (None, None))))
    return out


def run(spark, rows, ttl, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sessions.phases(df, "name", ttl, **options).select("name", "t", "seq", "phase", "login_t", "login_seq")
    return sorted(tuple(r) for r in got.collect())


def test_lifetime_is_strict_and_late_row_runs_on_old_session(spark):
    at = [0, 3600 * SECOND, 3600 * SECOND + 1, 3600 * SECOND + 2, 3600 * SECOND + 3]
    rows = [("a", t, i, True, True, False) for i, t in enumerate(at)]
    assert [r[3] for r in run(spark, rows, 3600)] == ["login", "live", "late", "login", "live"]


def test_failed_rows_neither_open_nor_clear(spark):
    rows = [("a", 0, 0, False, True, False), ("a", 1, 1, True, True, False), ("a", 100 * SECOND, 2, True, False, False),
            ("a", 101 * SECOND, 3, True, True, False), ("a", 102 * SECOND, 4, False, True, False), ("a", 103 * SECOND, 5, True, True, False),
            ("a", 104 * SECOND, 6, False, False, True), ("a", 105 * SECOND, 7, True, True, False)]
    assert [r[3] for r in run(spark, rows, 50)] == ["none", "login", "live", "late", "none", "login", "reset", "login"]


@pytest.mark.parametrize("seed, ttl", [(1, 30), (2, 300)])
def test_both_ways_follow_the_rules(spark, seed, ttl):
    rng, rows = random.Random(seed), []
    for name, n, resets in (("a", 300, 0.03), ("b", 40, 0.1), ("c", 250, 0.0), ("d", 1, 0.0)):
        t = 0
        for i in range(n):
            t += rng.choice([0, 1, 3, 20, 90]) * SECOND
            rows.append((name, t, i, rng.random() < 0.7, rng.random() < 0.7, rng.random() < resets))
    expected = sorted(walk(rows, ttl))
    assert run(spark, rows, ttl) == expected
    assert run(spark, rows, ttl, hot_rows=100) == expected


def test_summary_and_active(spark):
    rows = [("a", 0, 0, True, True, False), ("a", 5 * SECOND, 1, True, True, False), ("a", 20 * SECOND, 2, True, True, False), ("b", 0, 3, True, True, False)]
    done = sessions.phases(spark.createDataFrame(rows, SCHEMA), "name", 10)
    got = sorted((r["name"], r["n_rows"], r["late_seq"]) for r in sessions.summary(done, "name").collect())
    assert got == [("a", 3, 2), ("b", 1, None)]
    assert [r["name"] for r in sessions.active_at_end(done, "name").collect()] == ["b"]
