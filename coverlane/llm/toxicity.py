"""Toxic spans by a linear-chain conditional random field.

Two tags, clean and toxic. Labels say which documents are toxic, not where, so token labels
come first: words and word beginnings that mark toxic documents far beyond chance. The field
is trained on these tokens with features of the word and its neighbours, which carry the tag
to forms that the labels missed. Forward-backward marginals give each token's probability;
their log-sum over a document, calibrated on the training documents, is its score.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.llm.registry import query, table

TOKEN = re.compile(r"\w+")
BUCKETS = 1 << 18
STEMS = (4, 5, 6)


class Crf(NamedTuple):
    weights: np.ndarray  # per hashed feature: how much it speaks for toxic
    start: np.ndarray  # 2
    step: np.ndarray  # 2 x 2, from the first to the second tag
    scale: np.ndarray  # offset and factor of the document score


def forms(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


def _bucket(text: str) -> int:
    return xxhash.xxh64_intdigest(text) % BUCKETS


def features(word: str) -> tuple[list[int], list[int], list[int]]:
    """Buckets for the word as the token itself, as the one before and as the one after."""
    own = [_bucket("0" + f) for f in forms(word)]
    if word.isascii() and not word.isalpha():
        own.append(_bucket("digit"))
    return own, [_bucket("-" + word)], [_bucket("+" + word)]


class Vocabulary:
    """Numbers for words, with the three emission parts of each word once weights are known."""

    def __init__(self, weights: np.ndarray | None = None, most: int = 200_000):
        self.weights, self.most = None if weights is None else weights.tolist(), most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.parts: tuple[array, ...] = (array("f"), array("f"), array("f"))

    def ids(self, words: list[str]) -> np.ndarray:
        number, w = self.number, self.weights
        for word in set(words).difference(number):
            number[word] = len(number)
            if w is not None:
                own, before, after = features(word)
                self.parts[0].append(sum([w[f] for f in own]))
                self.parts[1].append(w[before[0]])
                self.parts[2].append(w[after[0]])
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def emission_parts(self, ids: np.ndarray) -> np.ndarray:
        return np.stack([np.frombuffer(part, np.float32)[ids] for part in self.parts], axis=1).astype(float)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def emissions(parts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Score of the toxic tag at each token; ``first`` marks where documents begin."""
    e = parts[:, 0].copy()
    inside = ~first[1:]
    e[1:] += np.where(inside, parts[:-1, 1], 0)
    e[:-1] += np.where(inside, parts[1:, 2], 0)
    return e


def _odds(gain: np.ndarray, reset: np.ndarray, at_reset: float, move: np.ndarray, width: int = 512) -> np.ndarray:
    """o[t] = gain[t] * (move[0, 1] + move[1, 1] * o[t-1]) / (move[0, 0] + move[1, 0] * o[t-1]), at_reset * gain[t] at resets.

    Stretches run side by side, each from so far ahead of its start that what came before
    no longer shows in double precision: every step shrinks a difference by a factor known
    from ``move`` (Birkhoff's contraction).
    """
    n = len(gain)
    spread = np.sqrt(np.exp(-abs(np.log(move[0, 0] * move[1, 1]) - np.log(move[0, 1] * move[1, 0]))))
    shrink = (1 - spread) / (1 + spread)
    ahead = 1 if shrink <= 0 else int(np.ceil(np.log(1e-18) / np.log(min(shrink, 1 - 1e-6))))
    if ahead >= n or n <= width:
        width, ahead = n, 0
    blocks = -(-n // width)

    def stretches(x: np.ndarray, fill: float) -> np.ndarray:
        padded = np.concatenate([np.full(ahead, fill, x.dtype), x, np.full(blocks * width - n, fill, x.dtype)])
        view = np.lib.stride_tricks.as_strided(padded, (blocks, ahead + width), (width * x.itemsize, x.itemsize))
        return np.ascontiguousarray(view.T)

    g, r = stretches(gain, 1.0), stretches(reset, True)
    out = np.empty((ahead + width, blocks))
    now = np.full(blocks, at_reset)
    for t in range(ahead + width):
        now = np.where(r[t], at_reset, (move[0, 1] + move[1, 1] * now) / (move[0, 0] + move[1, 0] * now)) * g[t]
        out[t] = now
    return out[ahead:].T.reshape(-1)[:n]


def marginals(e: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of toxic per token, and of each pair of tags of a token and the one before it.

    Documents lie end to end; ``first`` marks where one begins. Forward and backward values
    are odds of toxic to clean. A pair across a border means nothing.
    """
    gain, move = np.exp(np.clip(e, -30, 30)), np.exp(step)
    last = np.append(first[1:], True)
    ahead = _odds(gain, first, float(np.exp(start[1] - start[0])), move)
    behind = _odds(gain[::-1], last[::-1], 1.0, move.T)[::-1]  # with the token's own gain
    odds = ahead * behind / gain
    one, two = np.stack([np.ones(len(e)), ahead], axis=1)[:-1], np.stack([np.ones(len(e)), behind], axis=1)[1:]
    pair = one[:, :, None] * move[None] * two[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return odds / (1 + odds), pair


def token_labels(docs: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Words and beginnings that mark toxic documents far beyond chance, however many were tried.

    Three toxic documents must have it, and in as many places: between the same neighbours it
    counts once, so a word that only a group of copies shares is no mark. The floor doesn't grow
    with the sample, so more labels also teach rarer words.
    """
    bad, good = Counter(), Counter()
    for words, is_toxic in zip(docs, toxic, strict=True):
        if is_toxic:
            bad.update({f for w in set(words) for f in forms(w)})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    most, least = 2 * np.log(max(len(bad), 2) / 0.05), 3
    bad = {f: a for f, a in bad.items() if a >= least}
    for words, is_toxic in zip(docs, toxic, strict=True):
        if not is_toxic:
            good.update({f for w in set(words) for f in forms(w) if f in bad})

    def beyond_chance(a: int, b: int) -> bool:
        if a < least or a < 9 * b * n1 / n0 or a < 4 * b:
            return False
        x = np.array([[a, n1 - a], [b, n0 - b]], float)
        expected = x.sum(1, keepdims=True) * x.sum(0, keepdims=True) / x.sum()
        return 2 * np.sum(x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9))) > most

    found = {form for form, a in bad.items() if beyond_chance(a, good[form])}
    places: dict[str, set] = {form: set() for form in found}
    for words, is_toxic in zip(docs, toxic, strict=True):
        if is_toxic:
            for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                for form in forms(word):
                    if form in places:
                        places[form].add((before, after))
    return {form for form in found if beyond_chance(min(bad[form], len(places[form])), good[form])}


def document_value(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document the logit of its likeliest toxic token, plus the log of how many more there are."""
    if len(p) == 0:
        return np.full(len(bounds) - 1, -20.0)
    logit = np.log(np.clip(p, 1e-9, 1 - 1e-9)) - np.log(np.clip(1 - p, 1e-9, 1))
    out = np.full(len(bounds) - 1, -20.0)
    full = np.flatnonzero(np.diff(bounds))
    out[full] = np.maximum.reduceat(logit, bounds[:-1][full])
    heavy = np.add.reduceat(np.where(p > 0.5, p, 0.0), bounds[:-1][full])
    out[full] += np.log1p(heavy)
    return out


def train(texts: list[str], toxic: np.ndarray, epochs: int = 4, batch_tokens: int = 50_000, rate: float = 0.3,
          l2: float = 1e-5, seed: int = 7) -> Crf:
    """Fit the field by gradient steps on the log-likelihood of the token labels (Adagrad)."""
    docs = [tokens(t) for t in texts]
    marks = token_labels(docs, toxic)
    vocabulary = Vocabulary()
    coded = [vocabulary.ids(d) for d in docs]
    words = list(vocabulary.number)
    hit = np.array([any(f in marks for f in forms(w)) for w in words], bool)
    buckets, sizes = [array("q") for _ in range(3)], [array("q", [0]) for _ in range(3)]
    for word in words:
        for k, found in enumerate(features(word)):
            buckets[k].extend(found)
            sizes[k].append(len(found))
    flat, ends = [np.array(x, np.int64) for x in buckets], [np.cumsum(x) for x in sizes]
    weights, start, step = np.zeros(BUCKETS), np.zeros(2), np.zeros((2, 2))
    past, past_start, past_step = np.full(BUCKETS, 1e-4), np.full(2, 1e-4), np.full((2, 2), 1e-4)
    order, rng = np.flatnonzero([len(c) for c in coded]), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        at = 0
        while at < len(order):
            stop, size = at, 0
            while stop < len(order) and size < batch_tokens:
                size += len(coded[order[stop]])
                stop += 1
            part = [coded[i] for i in order[at:stop]]
            at = stop
            ids = np.concatenate(part)
            first = np.zeros(len(ids), bool)
            first[np.cumsum([0, *map(len, part[:-1])])] = True
            gold = hit[ids] & np.repeat([toxic[i] for i in order[at - len(part) : at]], list(map(len, part)))
            used, local = np.unique(ids, return_inverse=True)
            spot = []
            for k in range(3):
                sizes = np.diff(ends[k])[used]
                skip = ends[k][used] - np.cumsum(sizes) + sizes
                spot.append(flat[k][np.repeat(skip, sizes) + np.arange(sizes.sum())])
            owner = [np.repeat(np.arange(len(used)), np.diff(ends[k])[used]) for k in range(3)]
            parts = np.stack([np.bincount(owner[k], weights[spot[k]], len(used)) for k in range(3)], axis=1)[local]
            p, pair = marginals(emissions(parts, first), first, start, step)
            slope = (gold - p) / len(ids) * 100
            inside = ~first[1:]
            per = [np.bincount(local, slope, len(used)),
                   np.bincount(local[:-1], np.where(inside, slope[1:], 0), len(used)),
                   np.bincount(local[1:], np.where(inside, slope[:-1], 0), len(used))]
            grad = np.zeros(BUCKETS)
            for k in range(3):
                grad += np.bincount(spot[k], per[k][owner[k]], BUCKETS)
            grad -= l2 * weights
            past += grad * grad
            weights += rate * grad / np.sqrt(past)
            tag = gold.astype(int)
            seen = np.zeros((2, 2))
            np.add.at(seen, (tag[:-1][inside], tag[1:][inside]), 1)
            g = (seen - pair[inside].sum(axis=0)) / len(ids) * 100
            past_step += g * g
            step += rate * g / np.sqrt(past_step)
            g = (np.array([(first & ~gold).sum(), (first & gold).sum()]) - np.array([(1 - p)[first].sum(), p[first].sum()])) / len(ids) * 100
            past_start += g * g
            start += rate * g / np.sqrt(past_start)
    model = Crf(weights.astype(np.float32), start, step, np.array([0.0, 1.0]))
    return model._replace(scale=_calibrate(score_texts(texts, model, Vocabulary(model.weights))[0], toxic))


def _calibrate(value: np.ndarray, toxic: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Logistic regression of the label on the document value, by Newton steps with a weak prior."""
    x = np.stack([np.ones(len(value)), value], axis=1)
    w = np.array([0.0, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (toxic - p) - 0.1 * (w - [0, 1])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w = w + np.clip(move, -0.5, 0.5)
        if np.abs(move).max() < 1e-8:
            break
    return w if w[1] > 0 else np.array([w[0], 1e-3])


def score_texts(texts: list[str | None], model: Crf, vocabulary: Vocabulary, piece: int = 400_000) -> tuple[np.ndarray, list[np.ndarray]]:
    """Value of each document and the marginals of its tokens; whole texts, some at a time."""
    values, probabilities = np.empty(len(texts)), []
    at = 0
    while at < len(texts):
        ids, lengths, stop = [], [], at
        while stop < len(texts) and (stop == at or sum(lengths) < piece):
            if len(vocabulary.number) > vocabulary.most:
                if ids:
                    break
                vocabulary.clear()
            ids.append(vocabulary.ids(tokens(texts[stop])))
            lengths.append(len(ids[-1]))
            stop += 1
        bounds = np.cumsum([0, *lengths])
        flat = np.concatenate(ids)
        if len(flat):
            first = np.zeros(len(flat), bool)
            first[bounds[:-1][np.array(lengths) > 0]] = True
            p, _ = marginals(emissions(vocabulary.emission_parts(flat), first), first, model.start, model.step)
        else:
            p = np.zeros(0)
        values[at:stop] = document_value(p, bounds)
        probabilities.extend(np.split(p, bounds[1:-1]))
        at = stop
    return values, probabilities


RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                                     T.StructField("probability", T.DoubleType())]))),
])


def spans_of(text: str | None, p: np.ndarray, least: float) -> list[dict]:
    """Runs of tokens that are toxic with probability ``least`` or more, by character offset."""
    if not (p >= least).any():
        return []
    out, places = [], [m.span() for m in TOKEN.finditer(text or "")]
    if len(places) != len(p):  # lower-casing changed the token count: take offsets in the lower-cased text
        places = [m.span() for m in TOKEN.finditer(text.lower())]
    for i in np.flatnonzero(p >= least).tolist():
        if out and out[-1]["last"] == i - 1:
            out[-1] |= {"end": places[i][1], "last": i, "probability": max(out[-1]["probability"], float(p[i]))}
        else:
            out.append({"start": places[i][0], "end": places[i][1], "probability": float(p[i]), "last": i})
    return [{k: v for k, v in s.items() if k != "last"} for s in out]


def tag(docs: DataFrame, model: Crf, least: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans`` (start, end, probability) of toxic passages.

    Columns of these names are replaced. Null and empty texts have no tokens and get the
    score of a document without toxic tokens; repeated rows get equal scores.
    """
    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(model.weights)
        for texts in batches:
            texts = texts.tolist()
            values, p = score_texts(texts, model, vocabulary)
            with np.errstate(over="ignore"):
                score = 1 / (1 + np.exp(-(model.scale[0] + model.scale[1] * values)))
            yield pd.DataFrame({"score": score, "spans": [spans_of(t, q, least) for t, q in zip(texts, p, strict=True)]})

    kept = docs.drop("score", "spans").withColumn("_toxicity_tagged", scored("text"))
    return kept.select(*[F.col(f"`{c}`") for c in kept.columns if c != "_toxicity_tagged"], "_toxicity_tagged.*")


def held_out(doc_id: Column | str) -> Column:
    """Rows that are never learned from: the crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4_000, max_chars: int = 12_000_000) -> Crf:
    """Learn from labelled documents that are not held out: ``max_docs`` and ``max_chars`` at most.

    Half of them toxic if there are as many, those with the smallest hashes of their ids;
    longer documents go first when the characters run out. Null labels and ids are left out; of repeated ones
    toxic counts. Without labelled rows the field knows no toxic word.
    """
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id"))
             .groupBy("doc_id").agg((F.max("toxic") > 0).alias("_toxic")))
    some = [known.where(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2) for cond in ("_toxic", "NOT _toxic")]
    picked = F.broadcast(some[0].unionAll(some[1]))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(picked, "doc_id")
    size = F.sum(F.length("text")).over(Window.orderBy(F.length("text"), F.xxhash64("doc_id"), "text").rowsBetween(Window.unboundedPreceding, 0))
    seen = rows.withColumn("_size", size).where(F.col("_size") <= max_chars).select("doc_id", "text", "_toxic").collect()
    seen = sorted(seen)
    return train([r.text for r in seen], np.array([r._toxic for r in seen], bool)) if seen else Crf(
        np.zeros(BUCKETS, np.float32), np.zeros(2), np.zeros((2, 2)), np.array([-5.0, 1.0]))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return tag(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                   (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
