"""Quality rules: a decision list learned from labelled document statistics.

Sequential covering: a rule, a conjunction of thresholds, is grown condition by condition on
two thirds of the labelled rows, pruned from its end on the other third, and kept if it still
holds there; the rows it covers leave, and the next rule is learned. The list is a chain of
Spark conditions over statistics of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.llm.registry import WORD, query, table

_WORD = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Whole-number statistics of a text.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_same_next",
         "n_upper", "n_digits", "n_exclaim")

#: What conditions are about, as Spark expressions over the statistics.
FEATURES = {
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "same_next_share": "n_same_next / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaim_per_word": "n_exclaim / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def _repeated(words: list[str]) -> tuple[int, int]:
    """Words inside windows of eight that occur twice or more; words equal to the next one."""
    n = len(words)
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    same = int(np.count_nonzero(h[1:] == h[:-1]))
    if n <= WINDOW:
        return 0, same
    key = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : n - WINDOW + 1 + k]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0, same
    first, marked = {}, np.zeros(n + 1, np.int64)
    for i in np.flatnonzero(np.isin(key, twice)).tolist():  # equal hashes: compare the words themselves
        window = tuple(words[i : i + WINDOW])
        if (at := first.setdefault(window, i)) != i:
            for start in (at, i):
                marked[start] += 1
                marked[start + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(marked[:n]))), same


def text_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = _WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    repeat, same = _repeated(words)
    lower = text.lower()
    if len(lower) == len(text):
        code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        upper = int(np.count_nonzero(code(text) != code(lower)))
    else:
        upper = sum(c != c.lower() for c in text)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat, len(lines),
            len(set(words)), same, upper, sum(map(text.count, "0123456789")), text.count("!"))


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in STATS]))
def _stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_stats(text) for text in batch], columns=list(STATS), dtype="int64")


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of STATS (columns of these names are replaced); a null text has no words."""
    kept = docs.drop(*STATS).withColumn("_quality_stats", _stats("text"))
    return kept.select(*[F.col(f"`{c}`") for c in kept.columns if c != "_quality_stats"], "_quality_stats.*")


class Condition(NamedTuple):
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


def _holds(x: pd.DataFrame, rule: list[Condition]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        v = x[c.feature].to_numpy()
        hit &= v >= c.threshold if c.at_least else v <= c.threshold
    return hit


def _grow(x: pd.DataFrame, bad: np.ndarray, most: int, cuts: int) -> list[Condition]:
    """Add the condition with the best FOIL gain until only bad rows are covered."""
    rule: list[Condition] = []
    hit = np.ones(len(x), bool)
    while len(rule) < most and (hit & ~bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        best, gain = None, 1e-9
        for feature in x.columns:
            v = x[feature].to_numpy()
            seen = v[hit & bad]
            # thresholds halfway between neighbouring quantiles of all covered rows and of the bad ones
            for t in np.unique(np.concatenate([np.quantile(v[hit], np.linspace(0, 1, cuts)), np.quantile(seen, np.linspace(0, 1, cuts))])):
                for at_least in (True, False):
                    now = hit & (v >= t if at_least else v <= t)
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(feature, at_least, float(t)), g
        if best is None:
            break
        rule.append(best)
        hit &= _holds(x, [best])
    return rule


def _prune(x: pd.DataFrame, bad: np.ndarray, rule: list[Condition]) -> list[Condition]:
    """The beginning of the rule that does best on rows it was not grown on."""
    def worth(k: int) -> float:
        hit = _holds(x, rule[:k])
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def _loosen(x: pd.DataFrame, bad: np.ndarray, rule: list[Condition]) -> list[Condition]:
    """Move each threshold halfway to the nearest good row that the other conditions let through."""
    for i, c in enumerate(rule):
        others = _holds(x, rule[:i] + rule[i + 1 :])
        v = x[c.feature].to_numpy()
        beyond = v[others & ~bad & ((v < c.threshold) if c.at_least else (v > c.threshold))]
        inside = v[_holds(x, rule) & bad]
        if len(beyond) and len(inside):
            edge = (beyond.max() + inside.min()) / 2 if c.at_least else (beyond.min() + inside.max()) / 2
            rule = [*rule[:i], c._replace(threshold=float(edge)), *rule[i + 1 :]]
    return rule


def learn(rows: pd.DataFrame, precision: float = 0.95, support: int = 3, most_conditions: int = 4,
          most_rules: int = 32, cuts: int = 24) -> list[list[Condition]]:
    """A decision list that finds bad rows: feature columns and ``bad`` in ``rows``, in any order.

    A rule stays if at least ``precision`` of all rows it covers are bad, ``support`` of them
    or more. Rows of one class give an empty list.
    """
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    x, bad, third = rows.drop(columns="bad"), rows["bad"].to_numpy(bool), np.arange(len(rows)) % 3 == 0
    rules: list[list[Condition]] = []
    left = np.ones(len(rows), bool)
    while len(rules) < most_rules and (left & bad & ~third).any():
        grow, prune = left & ~third, left & third
        rule = _prune(x[prune], bad[prune], grown) if (grown := _grow(x[grow], bad[grow], most_conditions, cuts)) else []
        if not rule:
            break
        rule = _loosen(x[left], bad[left], rule)
        hit = _holds(x, rule) & left
        if (hit & bad).sum() < support or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_column(rules: list[list[Condition]]) -> Column:
    """The first rule that holds, as text; null if none does."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = rule[0].column()
        for c in rule[1:]:
            holds &= c.column()
        found = F.when(holds, F.lit(" and ".join(map(str, rule)))).otherwise(found)
    return found


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[list[Condition]]:
    """Learn from the labelled documents, ``max_rows`` of them at most.

    ``labels`` has ``doc_id`` and ``quality`` (0: bad); null labels and ids are left out, of
    repeated ones the worst counts. The rows taken are those with the smallest hash of the id.
    """
    picked = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = with_stats(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    seen = rows.select(*[F.expr(e).alias(name) for name, e in FEATURES.items()], (F.col("_quality") == 0).alias("bad")).toPandas()
    return learn(seen) if len(seen) else []


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``docs`` with statistics, ``base_failed``, ``rule`` (the first that holds) and ``kept``.

    Too short or too repetitive texts fail before any rule. Columns of these names are
    replaced; null and empty texts fail; repeated rows stay; no rows give no rows.
    """
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return (with_stats(docs.drop("base_failed", "rule", "kept"))
            .withColumns({"base_failed": failed, "rule": as_column(rules)})
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


@query("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).drop("text")
