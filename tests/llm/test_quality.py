"""Statistics against a plain count, the learner on planted rules, and odd rows."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from coverlane.llm import quality


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@pytest.mark.parametrize("seed", range(30))
def test_stats_match_plain_count(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a ", "b ", "c#", " ", "\n", "é\t", "a b a b\n", "\x1f"]) for _ in range(r.randrange(120)))
    assert quality.text_stats(text)[:5] == plain_stats(text)


def test_learner_finds_planted_conjunction():
    r = np.random.default_rng(1)
    x = pd.DataFrame({f: r.random(900) for f in ("symbols_per_char", "upper_share", "words")})
    x["bad"] = ((x.symbols_per_char > 0.6) & (x.words < 0.5)) | (x.upper_share > 0.9)
    rules = quality.learn(x)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= quality._holds(x, rule)
    assert (hit == x.bad).mean() > 0.97
    assert quality.learn(x.sample(frac=1, random_state=3)) == rules
    assert quality.learn(x.assign(bad=False)) == [] == quality.learn(x.assign(bad=True).head(0))


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x", 5), (2, "", "x", 5), (2, "", "x", 5), (3, "w " * 9 * 200, "x", 5), (None, " ".join(map(str, range(60))), "x", 5)],
                                 "doc_id long, text string, rule string, n_words long")
    labels = spark.createDataFrame([(None, 0), (1, None), (2, 0), (2, 1)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    out = quality.judge(docs, rules)
    got = sorted(((r.doc_id or -1, r.n_words, r.base_failed, r.kept, r.rule) for r in out.collect()), key=repr)
    assert got == [(-1, 60, False, True, None), (1, 0, True, False, None), (2, 0, True, False, None), (2, 0, True, False, None), (3, 1800, True, False, None)]
    assert quality.judge(docs.limit(0), rules).count() == 0
    assert quality.fit(docs.limit(0), labels) == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    seen = quality.judge(docs.select("doc_id", "text"), rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    wrong = seen.where("kept <> (quality = 1)").count()
    assert wrong < 0.02 * seen.count()
