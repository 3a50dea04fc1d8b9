"""SimHash near-duplicates with pigeonring filtering.

Fingerprints that differ in at most ``d`` bits are cut into more than ``d`` segments on a
ring. The pigeonring principle: from some segment on, every chain of consecutive segments
differs in no more than its proportional share of ``d``. So the first segment of the chain
is equal, the first two differ in at most ``2 d / m`` bits, and so on. The first segment
and equal parts of the next ones are the keys under which candidates meet; the whole chain
prunes them before the full bit count.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.llm.components import components
from coverlane.llm.registry import WORD, query, table
from coverlane.session import settle

_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BITS = 64


def text_fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes. No word: zero."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(" ".join(words[i : i + shingle]), seed) for i in range(n)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with ``fingerprint``, a long of 64 bits; a column of this name is replaced."""

    @F.pandas_udf(T.LongType())
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.fromiter((text_fingerprint(t, shingle, seed) for t in batch), np.uint64, len(batch))
            yield pd.Series(found.view(np.int64))

    return docs.withColumn("fingerprint", fingerprint("text"))


def _segments(m: int) -> list[tuple[int, int]]:
    """First bit and width of each of ``m`` segments."""
    edges = [round(k * BITS / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def key_parts(distance: int) -> list[list[list[int]]]:
    """For each first segment, the sets of bits under which candidates meet.

    A chain of three segments may differ in ``3 d // m`` bits in the second and third, which
    are cut into two more parts than that: two parts at least are equal.
    """
    m = distance + 1
    ring = _segments(m)
    bits = lambda k: list(range(ring[k % m][0], sum(ring[k % m])))
    found = []
    for start in range(m):
        first = bits(start)
        rest = [b for k in range(1, min(3, m)) for b in bits(start + k)]
        budget = 3 * distance // m if m >= 3 else distance
        parts = [p.tolist() for p in np.array_split(rest, budget + 2) if len(p)] if rest else []
        pairs = list(itertools.combinations(range(len(parts)), 2))
        found.append([first + parts[a] + parts[b] for a, b in pairs] or [first])
    return found


def _keys(fingerprints: np.ndarray, distance: int) -> list[tuple[int, int, np.ndarray]]:
    """(first segment, key kind, key value) of every kind of key."""
    out, kind = [], 0
    for start, sets in enumerate(key_parts(distance)):
        for bits in sets:
            mask = np.uint64(sum(1 << b for b in bits))
            out.append((start, kind, fingerprints & mask))
            kind += 1
    return out


def _near(one: np.uint64, others: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Which of ``others`` link to ``one``: the chain from ``start`` first, then all bits."""
    m = distance + 1
    ring = _segments(m)
    differ = others ^ one
    alive = np.arange(len(others))
    so_far = np.zeros(len(others), np.int64)
    for length in range(1, m + 1):
        first, width = ring[(start + length - 1) % m]
        mask = np.uint64(((1 << width) - 1) << first)
        so_far = so_far + np.bitwise_count(differ & mask)
        keep = so_far * m <= length * distance
        if not keep.all():
            alive, differ, so_far = alive[keep], differ[keep], so_far[keep]
    return alive  # the last chain is the whole ring: the full Hamming check


def _chain_links(block: np.ndarray, start: int, distance: int) -> Iterator[tuple[int, int]]:
    """Enough links inside a block to connect all its fingerprints that are linked there.

    A search visits each fingerprint once and compares it with those not visited yet, so a
    dense block costs little more than its size, and links are fewer than fingerprints.
    """
    left = block
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            hit = _near(one, left, start, distance)
            if len(hit):
                found = left[hit]
                left = np.delete(left, hit)
                queue.extend(found)
                for other in found:
                    yield int(one), int(other)


def links(fingerprints: DataFrame, distance: int = 4, piece: int = 20_000) -> DataFrame:
    """``a, b``: links between distinct fingerprints that give the components of all links.

    Candidates meet by key. The fingerprints of one key come sorted and are compared in
    pieces of ``piece``; where a key has more than one piece, pairs of pieces are dealt out
    as tasks of their own, so no task holds more than two pieces. Null fingerprints are left
    out.
    """
    starts = [k for k, sets in enumerate(key_parts(distance)) for _ in sets]
    distinct = fingerprints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    keyed = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("fingerprint", T.LongType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for _, kind, key in _keys(value, distance):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), kind, np.int32)), pa.array(key.view(np.int64)), batch.column(0)], names=keyed.names)

    # A piece that is not alone goes out again as rows with its number, to meet the others.
    found = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("part", T.IntegerType()),
                          T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def batch_of(kind, key, part, a, b) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([key] * n, pa.int64()), pa.array([part] * n, pa.int32()),
                                           pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=found.names)

    def linked(block: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array(list(_chain_links(block, start, distance)), np.uint64).reshape(-1, 2).view(np.int64)
        return pairs[:, 0], pairs[:, 1]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, part = None, [], 0

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, part
            block = np.concatenate(held) if held else np.zeros(0, np.uint64)
            if len(block) > 1:
                a, b = linked(block, starts[at[0]])
                if len(a):
                    yield batch_of(None, None, None, a, b)
            if len(block) and (part or not last):
                yield batch_of(at[0], at[1], part, block.view(np.int64), [None] * len(block))
            held, part = [], 0 if last else part + 1

        for batch in batches:
            kind, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            value = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            edges = np.concatenate([[0], np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1, [len(value)]])
            wide = np.diff(edges) > 1  # inside a batch, a fingerprint alone under its key has no candidates
            wide[[0, -1]] = True
            for k in np.flatnonzero(wide).tolist():
                lo, hi = int(edges[k]), int(edges[k + 1])
                if at != (now := (int(kind[lo]), int(key[lo]))):
                    yield from close(last=True)
                    at = now
                for i in range(lo, hi, piece):
                    part_now = value[i : min(hi, i + piece)]
                    if sum(map(len, held)) + len(part_now) > piece:
                        yield from close(last=False)
                    held.append(part_now)
        yield from close(last=True)

    met = settle(distinct.mapInArrow(spread, keyed).repartition("kind", "key").sortWithinPartitions("kind", "key", "fingerprint")
                 .mapInArrow(meet, found), "simhash")
    pieces = met.where("part IS NOT NULL")
    parts = pieces.groupBy("kind", "key").agg(F.max("part").alias("last"))
    pairs = (pieces.join(parts, ["kind", "key"])
             .select("kind", "key", "part", F.col("a").alias("fingerprint"), F.explode(F.sequence(F.lit(0), "last")).alias("other"))
             .where("part <> other").select("kind", "key", "fingerprint", F.col("part"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")))
    between = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        value = rows["fingerprint"].to_numpy(np.int64).view(np.uint64)
        a, b = linked(value, starts[int(rows["kind"].iloc[0])])
        return pd.DataFrame({"a": a, "b": b})

    return met.where("b IS NOT NULL").select("a", "b").unionAll(pairs.groupBy("kind", "key", "lo", "hi").applyInPandas(across, between))


def groups(docs: DataFrame, shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, text_hash, fingerprint, group, component_id``, one row per row of ``docs``.

    ``fingerprint`` is a long of 64 bits, ``group`` a fingerprint that names the component,
    ``component_id`` the smallest ``doc_id`` of all
    documents that links lead to. Null and empty texts have the fingerprint zero, like any
    text without words, and are linked. Repeated rows stay and share a component; a null
    ``doc_id`` names no component, so one of nulls only is null. Other columns are left out;
    no rows give no rows. Equal fingerprints are one node: copies are never compared.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    ids = settle(with_fingerprint(docs.select("doc_id", "text"), shingle, seed).select("doc_id", hashed, "fingerprint"), "fingerprints")
    nodes = ids.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    found = settle(components(links(ids, distance), "a", "b"), "groups")
    nodes = settle(nodes.join(found, nodes["fingerprint"] == found["node"], "left")
                   .select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("group")), "nodes")
    named = settle(nodes.groupBy("group").agg(F.min("least").alias("component_id")), "names")
    names = settle(nodes.join(named, "group").select("fingerprint", "group", "component_id"), "names")
    return ids.join(names, "fingerprint").select("doc_id", "text_hash", "fingerprint", "group", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """One document of each group of ``docs``: that with the smallest ``doc_id`` (nulls last), all columns kept.

    Of a row repeated with its ``doc_id`` and text, one stays.
    """
    key = {"_simhash_none": F.col("doc_id").isNull(), "_simhash_id": F.coalesce("doc_id", F.lit(0).cast("long")), "_simhash_text": F.xxhash64(F.coalesce("text", F.lit("")))}
    member = groups(docs, shingle, distance, seed)
    first = member.groupBy("group").agg(
        F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").isNull().alias("_simhash_none"), F.coalesce("first.doc_id", F.lit(0).cast("long")).alias("_simhash_id"),
                         F.col("first.text_hash").alias("_simhash_text"))
    once = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return docs.withColumns(key).join(settle(first, "first"), list(key), "left_semi").withColumn("_simhash_once", once).where("_simhash_once = 1").drop(*key, "_simhash_once")


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark, sf_dir):
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
