"""Marginals against all tag sequences, spans, held-out accuracy and odd rows."""

import itertools

import numpy as np

from coverlane.llm import toxicity


def plain_marginals(e, first, start, step):
    p = np.zeros(len(e))
    total = 0.0
    for tags in itertools.product((0, 1), repeat=len(e)):
        score = sum(e[t] * tags[t] + (start[tags[t]] if first[t] else step[tags[t - 1], tags[t]]) for t in range(len(e)))
        total += np.exp(score)
        p += np.exp(score) * np.array(tags)
    return p / total


def test_marginals_match_all_sequences():
    r = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        e, first = r.normal(size=n) * 2, r.random(n) < 0.3
        first[0] = True
        start, step = r.normal(size=2), r.normal(size=(2, 2))
        p, _ = toxicity.marginals(e, first, start, step)
        assert np.allclose(p, plain_marginals(e, first, start, step))


def test_side_by_side_equals_one_pass():
    r = np.random.default_rng(1)
    n = 5000
    gain, reset, move = np.exp(r.normal(size=n) * 3), r.random(n) < 0.001, np.exp(r.normal(size=(2, 2)))
    reset[0] = True
    assert np.allclose(toxicity._odds(gain, reset, 0.7, move), toxicity._odds(gain, reset, 0.7, move, width=n), rtol=1e-12)


def corpus(n):
    r = np.random.default_rng(n)
    words = [f"w{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(n):
        doc = r.choice(words, 40).tolist()
        if i % 4 == 0:
            for at in r.choice(40, 3, replace=False):
                doc[at] = r.choice(["awful", "awfully", "vilest"])
        texts.append(" ".join(doc))
        toxic.append(i % 4 == 0)
    return texts, np.array(toxic)


def test_training_finds_planted_words_and_their_forms():
    texts, toxic = corpus(600)
    model = toxicity.train(texts, toxic)
    values, p = toxicity.score_texts(["w1 w2 awfulness w3 w4", "w1 w2 w3", "", None], model, toxicity.Vocabulary(model.weights))
    score = 1 / (1 + np.exp(-(model.scale[0] + model.scale[1] * values)))
    assert score[0] > 0.5 > score[1] and score[2] < 0.5 and score[3] < 0.5
    assert p[0].argmax() == 2 and toxicity.spans_of("w1 w2 awfulness w3 w4", p[0], p[0].max())[0]["start"] == 6


def test_rare_toxic_words_are_learned():
    """Two words in one of a hundred toxic documents each: few, but never in a clean one."""
    r = np.random.default_rng(4)
    words, kind = [f"w{i}" for i in range(300)], ["zorvex", "quimbly"]
    docs = [r.choice(words, 40).tolist() for _ in range(4000)]
    toxic = np.arange(4000) % 2 == 0
    for n, i in enumerate(np.flatnonzero(toxic).tolist()):
        for at in r.choice(40, 3, replace=False):
            docs[i][at] = kind[n // 50 % 2] if n % 50 == 0 else "awful"
    marks = toxicity.token_labels(docs, toxic)
    assert {"awful", *kind} <= marks and not marks & set(words)


def test_odd_rows_and_clashing_columns(spark):
    texts, toxic = corpus(300)
    docs = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(texts)), (900, None, "x"), (900, "", "x"), (None, "İawful " * 3000, "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([*((i, int(t)) for i, t in enumerate(toxic)), (None, 1), (5, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {(r.doc_id, r.text or ""): r for r in toxicity.tag(docs, model).collect()}
    assert len(out) == 302 and out[900, ""].spans == []
    assert np.mean([(out[i, t].score >= 0.5) == x for i, (t, x) in enumerate(zip(texts, toxic, strict=True))]) > 0.9
    assert len(out[None, "İawful " * 3000].text) == 21000
    assert toxicity.tag(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.tag(docs, none).where("score >= 0.5").count() == 0


def test_held_out_accuracy(spark):
    from coverlane.llm.queries import QUERIES

    d = "/root/testdata/sf0.1"
    found = QUERIES["op6_toxicity"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert ((found.predicted == 1) == (found.toxic == 1)).mean() > 0.95
