"""Components against union-find, links in pages, block decisions over aliases, odd rows."""

import random

from pyspark.sql import functions as F

from coverlane.llm import urls
from coverlane.llm.components import components


def test_components_match_union_find(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 80)]
    pairs += [(None, 3), (7, 7), pairs[0]]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_parts_of_urls(spark):
    texts = ["HTTP://A.Ex/p/q?x#y", "//a/b", None, "", "x://H?q", "a://b://c/d", "http://É.net", "h://a#/b"]
    df = spark.createDataFrame([(t,) for t in texts], "url string")
    got = [tuple(r) for r in df.select(urls.host(F.col("url")), urls.path(F.col("url"))).collect()]
    assert got == [("a.ex", "/p/q"), ("", ""), ("", ""), ("", ""), ("h", ""), ("b:", "//c/d"), ("É.net", ""), ("a", "")]


PAGES = [
    (1, "http://a.example.org/x", '<link rel="canonical" href="https://b.example.net/y">', "v"),
    (2, "http://b.example.net/y", "", "v"),
    (3, "http://c.example.org/z?k=1", "<meta http-equiv=refresh content='0; url=/w'>", "v"),
    (4, "http://c.example.org/w#top", "<LINK href='//d.example.org/v' REL=canonical>", "v"),
    (5, "http://d.example.org/v", '<link rel="canonical" href="http://blocked.net/">', "v"),
    (6, "http://e.example.org/u", '<!-- <link rel="canonical" href="http://blocked.net/"> -->', "v"),
    (7, "http://f.example.org/fr/t", '<link rel="canonical" href="http://blocked.net/other">', "v"),
    (8, "http://g.example.org/s", '<link rel="canonical" href="/fr/t2"><link rel="canonical" href="http://blocked.net/third">', "v"),
    (9, None, None, "v"), (10, "no scheme", '<link rel="canonical" href="http://blocked.net/">', "v"), (1, "http://a.example.org/x", None, "v"),
    (11, "http://blocked.net", "", "v"),
]


def test_blocks_spread_and_allows_win(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, verdict string")
    out = [(r.page_id, r.rule, r.verdict) for r in urls.judge(df, urls.page_links(df), urls.RULES).collect()]
    want = sorted([
        (1, None, "block"), (1, None, "block"), (2, "net/", "block"), (3, None, "block"), (4, None, "block"), (5, None, "block"), (6, None, "allow"),
        (7, "org/fr/", "allow"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow"), (11, None, "allow")], key=str)
    assert sorted(out, key=str) == want
    verdicts = {r[0]: r[2] for r in out}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    assert urls.judge(df.limit(0), urls.page_links(df.limit(0)), urls.RULES).count() == 0


def test_longest_rule_wins(spark):
    df = spark.createDataFrame([("x://m.example.net/en/a",), ("x://example.net/de/",), ("x://notexample.com/de/",), ("x://q.org/fr/",), ("x://net/",), ("x://net",)], "url string")
    got = [r[0] for r in df.select(urls.best_rule(urls.RULES, urls.host(F.col("url")), urls.path(F.col("url")))["rule"]).collect()]
    assert got == ["example.net/en/", "net/", None, "org/fr/", "net/", None]
