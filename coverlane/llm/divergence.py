"""Source divergence audit: how far each source's term distribution lies from its language's.

Two passes over the documents.

1. Exact frequency filtering, in Spark: the distinct terms of every document are counted
   per language, and a language keeps the terms found in at least ``min_docs`` documents.
2. Recount by minimal perfect hashes: the kept (language, term) keys are dealt into shards
   by a hash of the key; every shard gets a minimal perfect hash (levels of bit arrays, each
   key alone in its place at some level, the place's rank is its slot) that stores the keys
   by slot. Shards are broadcast in rounds of at most ``round_bytes``. Each task splits its
   texts into terms, looks every distinct term up once, checks the stored key (a term that
   is not kept falls on some slot too, and the check turns it away), and increments the
   dense slot array of the document's (language, source) group. The arrays are written out
   as (group, term, count) when a task ends or holds more than ``cells`` slots, and Spark
   adds them up.

Terms are split from UTF-8 bytes by one byte table (see ``terms_of``), which gives the matches of
TERM. The scores are exact integer arithmetic: per group and per language,
a term's weight is ``p = 1 + floor(10^9 (count + 2) / (N + 2V))``; two weights differ by
``f = floor((p - q)^2 / (p + q))``. Part ``pair`` sums f over all kept terms between a group
and every other source of its language; part ``term`` lists the ten terms of a group that
lie most above the language. Terms with count 0 on both sides of a pair are not visited
one by one: they all have the same f, which is multiplied by their number.

Defined results: null text, lang or source read as ''. A group without terms still has
pair rows (its p is that of count 0); a language with no kept term gives value 0 in all its
pairs and no term rows. A language with one source gives no pair rows. Empty tables give no
rows. Repeated rows count as separate documents. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.llm.registry import query, table
from coverlane.session import settle

# Fixed values of the contract: the term pattern, the document floor and the scale.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _byte_table() -> bytes:
    """UTF-8 bytes that end terms become blanks, A-Z lower case. Every byte of a non-ASCII
    character is 0x80 or more and stays, so the runs left are exactly the matches of TERM."""
    table = bytearray(range(256))
    for c in [*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]:
        table[c] = 0x20
    for c in range(0x41, 0x5B):
        table[c] = c + 0x20
    return bytes(table)


_BYTES = _byte_table()


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, lower-cased, as UTF-8 bytes."""
    return list(filter(None, raw.translate(_BYTES).split(b" ")))

#: Keys in one shard of the perfect hash; bytes of shards broadcast at a time; dense cells a task holds.
SHARD_KEYS = 1 << 20
ROUND_BYTES = 256 << 20
CELLS = 1 << 24
#: Entries of the per-task tables of counted or looked-up terms before they are handed on or emptied.
CACHE = 1 << 20
#: Rows that a task hands on at a time, and documents whose terms it splits at a time.
OUT_ROWS = 1 << 15
DOCS = 200
#: Places per key at each level of the perfect hash.
GAMMA = 2.0


# ---------------------------------------------------------------------------------------
# Minimal perfect hash with stored keys

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A different 64-bit hash of the key hash for every level (the finaliser of MurmurHash3)."""
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(33)
        x *= _M1
        x ^= x >> np.uint64(33)
        x *= _M2
        x ^= x >> np.uint64(33)
    return x


def key_hash(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def build(keys: list[str], gamma: float = GAMMA) -> dict:
    """A minimal perfect hash of distinct ``keys``: slots 0 .. n-1, keys stored by slot.

    At every level each left key takes a place out of ``gamma`` times as many; places that
    exactly one key takes are set, and their keys are done. The rest go on to the next
    level. Keys left after 64 levels (never seen in practice) are kept in a plain table.
    """
    h = key_hash(keys)
    left = np.arange(len(keys))
    levels, slot_of, base = [], np.full(len(keys), -1, np.int64), 0
    for level in range(64):
        if len(left) == 0:
            break
        size = max(64, int(math.ceil(gamma * len(left))))
        place = (_mix(h[left], level) % np.uint64(size)).astype(np.int64)
        taken = np.bincount(place, minlength=size)
        bits = taken == 1
        rank = np.cumsum(bits) - bits
        alone = bits[place]
        slot_of[left[alone]] = base + rank[place[alone]]
        levels.append((size, np.packbits(bits)))
        base += int(bits.sum())
        left = left[~alone]
    rest = {keys[i]: base + j for j, i in enumerate(left)}
    stored = [None] * len(keys)
    for i, s in enumerate(slot_of):
        if s >= 0:
            stored[s] = keys[i]
    for k, s in rest.items():
        stored[s] = k
    return {"levels": levels, "rest": rest, "keys": stored}


class Lookup:
    """Slots of keys in one built hash; -1 for keys that it does not hold."""

    def __init__(self, built: dict, offset: int = 0):
        self.levels = []
        base = 0
        for size, packed in built["levels"]:
            bits = np.unpackbits(packed, count=size).astype(bool)
            self.levels.append((size, bits, np.cumsum(bits) - bits, base))
            base += int(bits.sum())
        self.rest, self.keys, self.offset = built["rest"], built["keys"], offset

    def slots(self, keys: list[str]) -> np.ndarray:
        h = key_hash(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.ones(len(keys), bool)
        for level, (size, bits, rank, base) in enumerate(self.levels):
            if not open_.any():
                break
            place = (_mix(h, level) % np.uint64(size)).astype(np.int64)
            hit = open_ & bits[place]
            out[hit] = base + rank[place[hit]]
            open_ &= ~hit
        for i in np.flatnonzero(open_):
            out[i] = self.rest.get(keys[i], -1)
        for i, s in enumerate(out):
            if s >= 0 and self.keys[s] != keys[i]:
                out[i] = -1
        return np.where(out >= 0, out + self.offset, -1)


# ---------------------------------------------------------------------------------------
# The two passes

def normal(docs: DataFrame) -> DataFrame:
    """lang and source with nulls as '', and the text's UTF-8 bytes (null: none); terms are split from those."""
    return docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, cells: int = None) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` documents of the language; exact counts.

    Each task counts the documents of every (lang, term) it sees and hands on the partial
    counts (when it ends, or when it holds ``cells`` of them); Spark adds them up.
    """
    cells = cells or CELLS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counted = iter(counts.items())
                while some := list(islice(counted, OUT_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([t.decode() for t, _ in some], pa.string()),
                                                      pa.array([n for _, n in some], pa.int64())], names=["lang", "term", "docs"])
            held.clear()

        for b in _few(batches):
            found = [terms_of(text) for text in b.column("text").to_pylist()]
            for lang, docs in _by_lang(b.column("lang").to_pylist()).items():
                codes, uniques, lengths = _factorized(found, docs)
                if not len(uniques):
                    continue
                doc_of = np.repeat(np.arange(len(docs), dtype=np.int64), lengths)
                distinct = np.unique(doc_of * len(uniques) + codes) % len(uniques)
                df = np.bincount(distinct, minlength=len(uniques))
                held.setdefault(lang, Counter()).update(dict(zip(uniques, df.tolist())))
            if sum(map(len, held.values())) > CACHE:
                yield from out()
        if held:
            yield from out()

    partial = docs.select("lang", "text").mapInArrow(count, "lang string, term string, docs long")
    return partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")


def _key(lang: str, term: str) -> str:
    # Terms never hold \x00, so the key splits again at its last \x00.
    return f"{lang}\x00{term}"


def hashes(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(shard, n, blob), a built perfect hash per shard of the kept keys, and the number of shards."""
    n = kept.count()
    shards = max(1, -(-n // shard_keys))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(a, t) for a, t in zip(b.column("lang").to_pylist(), b.column("term").to_pylist())]
            shard = (key_hash(keys) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys, pa.string())], names=["shard", "key"])

    def make(batch):
        keys = sorted(batch["key"])
        return pd.DataFrame({"shard": [int(batch["shard"].iloc[0])], "n": [len(keys)],
                                               "blob": [pickle.dumps(build(keys), protocol=5)]})

    dealt = kept.mapInArrow(deal, "shard int, key string")
    return settle(dealt.groupBy("shard").applyInPandas(make, "shard int, n long, blob binary"), "divergence-hashes"), shards


def recount(docs: DataFrame, hashed: DataFrame, shards: int, round_bytes: int = ROUND_BYTES, cells: int = CELLS) -> DataFrame:
    """(lang, source, term, count) of kept terms with count > 0, by dense slots per group."""
    spark = docs.sparkSession
    sizes = hashed.select("shard", F.length("blob").alias("bytes")).orderBy("shard").collect()
    rounds, now, used = [], [], 0
    for r in sizes:
        if now and used + r.bytes > round_bytes:
            rounds.append(now)
            now, used = [], 0
        now.append(r.shard)
        used += r.bytes
    if now:
        rounds.append(now)
    found = []
    for picked in rounds:
        blobs = {r.shard: bytes(r.blob) for r in hashed.where(F.col("shard").isin(picked)).collect()}
        shared = spark.sparkContext.broadcast(blobs)
        found.append(docs.mapInArrow(_counter(shared, shards, cells), "lang string, source string, term string, count long"))
    if not found:
        return spark.createDataFrame([], "lang string, source string, term string, count long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``DOCS`` at a time: their terms are objects on their own for that long."""
    for b in batches:
        for at in range(0, b.num_rows, DOCS):
            yield b.slice(at, DOCS)


def _by_lang(langs: list[str]) -> dict[str, np.ndarray]:
    """Row numbers of each language in a batch."""
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    return {lang: np.asarray(r, np.int64) for lang, r in rows.items()}


def _factorized(found: list[list[bytes]], docs: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes of all terms of the given documents, in order, their distinct terms and each document's count."""
    lengths = np.fromiter((len(found[i]) for i in docs), np.int64, len(docs))
    flat = np.fromiter(chain.from_iterable(found[i] for i in docs), object, int(lengths.sum()))
    codes, uniques = pd.factorize(flat)
    return codes.astype(np.int64), list(uniques), lengths


def _counter(shared, shards: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups, total = {}, 0
        for shard, blob in sorted(shared.value.items()):
            built = pickle.loads(blob)
            lookups[shard] = Lookup(built, total)
            total += len(built["keys"])
        # slots of each language numbered from 0, so that a group's dense array holds its language only
        local = np.zeros(total, np.int64)
        words: dict[str, list[str]] = {}
        for lk in lookups.values():
            for s, key in enumerate(lk.keys, lk.offset):
                lang, term = key.rsplit("\x00", 1)
                mine = words.setdefault(lang, [])
                local[s] = len(mine)
                mine.append(term)
        stride = max((len(w) for w in words.values()), default=1)
        dense: dict[tuple[str, str], np.ndarray] = {}
        known: dict[str, dict[str, int]] = {}
        seen = added = held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), arr in dense.items():
                own, nz = words[lang], np.flatnonzero(arr)
                for at in range(0, len(nz), OUT_ROWS):
                    some = nz[at : at + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                                                      pa.array([own[s] for s in some.tolist()], pa.string()), pa.array(arr[some].astype(np.int64))],
                                                     names=["lang", "source", "term", "count"])
            dense.clear()

        if total == 0:
            return
        for b in _few(batches):
            langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
            found = [terms_of(text) for text in b.column("text").to_pylist()]
            # per language of the batch: its terms factorized, only distinct ones looked up, new ones
            # in the perfect hash once
            groups: dict[tuple[str, str], int] = {}
            gid = np.fromiter((groups.setdefault((lang, source), len(groups)) for lang, source in zip(langs, sources)), np.int64, len(langs))
            all_ids, all_owner = [], []
            for lang, docs in _by_lang(langs).items():
                codes, uniques, lengths = _factorized(found, docs)
                if not len(uniques):
                    continue
                if seen > CACHE:
                    for table_ in known.values():
                        table_.clear()
                    seen = 0
                mine = known.setdefault(lang, {})
                fresh = [u for u in uniques if u not in mine]
                if fresh:
                    keys = [_key(lang, t.decode()) for t in fresh]
                    hs = key_hash(keys) % np.uint64(shards)
                    slot = np.full(len(keys), -1, np.int64)
                    for shard, lk in lookups.items():
                        picked = np.flatnonzero(hs == np.uint64(shard))
                        if len(picked):
                            slot[picked] = lk.slots([keys[i] for i in picked])
                    mine.update(zip(fresh, slot.tolist()))
                    seen += len(fresh)
                slots = np.fromiter(map(mine.__getitem__, uniques), np.int64, len(uniques))
                all_ids.append(slots[codes])
                all_owner.append(np.repeat(gid[docs], lengths))
            ids = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int64)
            owner = np.concatenate(all_owner) if all_owner else np.zeros(0, np.int64)
            hit = ids >= 0
            joint, counts = np.unique(owner[hit] * stride + local[ids[hit]], return_counts=True)
            added += int(counts.sum())
            for group, g in groups.items():
                lo, hi = np.searchsorted(joint, [g * stride, (g + 1) * stride])
                if lo == hi:
                    continue
                if group not in dense:
                    size = len(words[group[0]])
                    if dense and (held + size > cells or added >= 2**31 - 1):
                        yield from flush()
                        added = held = 0
                    dense[group] = np.zeros(size, np.int32)
                    held += size
                dense[group][joint[lo:hi] - g * stride] += counts[lo:hi].astype(np.int32)
        if dense:
            yield from flush()

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_keys: int = SHARD_KEYS,
          round_bytes: int = ROUND_BYTES, cells: int = CELLS, block_cells: int | None = None) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of parts ``pair`` and ``term``."""
    docs = normal(docs)
    kept = settle(kept_terms(docs, min_docs, cells), "divergence-kept")
    hashed, shards = hashes(kept, shard_keys)
    counts = settle(recount(docs.select("lang", "source", "text"), hashed, shards, round_bytes, cells), "divergence-counts")
    return scores(docs.select("lang", "source").distinct(), kept, counts, top, block_cells or BLOCK_CELLS)


#: Cells (sources x terms) of one dense block in the scoring tasks.
BLOCK_CELLS = 1 << 22


def _weights(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """p = 1 + floor(SCALE (count + 2) / (n + 2v)), exact; Python integers where int64 could overflow.

    ``counts`` is (sources x terms) with ``n`` per source, or one row with a single ``n``.
    """
    wide = counts.size and int(counts.max()) + 2 > (2**62) // SCALE
    c = counts.astype(object) if wide else counts
    d = (n.astype(object) if wide else n) + 2 * v
    return 1 + (SCALE * (c + 2)) // (d[:, None] if counts.ndim == 2 else d)


def _f(p, q):
    return ((p - q) * (p - q)) // (p + q)


def _block(top: int):
    """Scores of one (language, term bucket): pair sums over its terms and the best terms per source."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lang, v = rows["lang"].iloc[0], int(rows["v"].iloc[0])
        marks = rows[rows["term"].isna()].drop_duplicates("source")
        sources = sorted(marks["source"], key=lambda x: x.encode())
        at = {x: i for i, x in enumerate(sources)}
        n = np.zeros(len(sources), np.int64)
        n[[at[x] for x in marks["source"]]] = marks["n"].to_numpy(np.int64)
        cells = rows[rows["term"].notna()]
        terms = sorted(set(cells["term"]))
        col = {t: j for j, t in enumerate(terms)}
        dense = np.zeros((len(sources), len(terms)), np.int64)
        if len(cells):
            dense[[at[x] for x in cells["source"]], [col[t] for t in cells["term"]]] = cells["count"].to_numpy(np.int64)
        p = _weights(dense, n, v)
        q = _weights(dense.sum(axis=0), np.array(n.sum()), v)
        out = []
        for i, a in enumerate(sources):
            sums = _f(p[i][None, :], p).sum(axis=1) if len(terms) else np.zeros(len(sources), np.int64)
            out += [(lang, a, "pair", b, int(sums[j]), len(terms)) for j, b in enumerate(sources) if j != i]
            above = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            values = _f(p[i][above], q[above])
            best = sorted(zip((-int(x) for x in values), (terms[j].encode() for j in above)))[:top]
            out += [(lang, a, "term", t.decode(), -x, 0) for x, t in best]
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value", "seen"])

    return run


def scores(groups: DataFrame, kept: DataFrame, counts: DataFrame, top: int = TOP, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """The two parts from groups, kept terms and the counts of kept terms per group.

    Terms of a language are dealt into buckets so that (sources x terms of a bucket) stays
    near ``block_cells``; one task scores a bucket densely in NumPy: the pair sums over its
    terms (added up over buckets by Spark) and each source's best terms (of which Spark
    keeps the best over buckets). Terms that no group of the language has cannot be kept,
    so every kept term is in some bucket.
    """
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    g = (groups.join(v, "lang", "left").join(n, ["lang", "source"], "left")
         .select("lang", "source", F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    g = settle(g, "divergence-groups")
    size = g.groupBy("lang").agg(F.count("*").alias("s"), F.first("v").alias("v"))
    size = size.select("lang", "v", F.greatest(F.lit(1), F.ceil(F.col("s") * F.col("v") / F.lit(block_cells))).cast("long").alias("b"))
    bucket = F.pmod(F.xxhash64("term"), F.col("b"))
    cells = counts.join(size, "lang").select("lang", "v", bucket.alias("bucket"), "source", "term", "count", F.lit(None).cast("long").alias("n"))
    marks = (g.join(size, ["lang", "v"]).where(F.col("v") > 0)
             .select("lang", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("bucket"), "source",
                     F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("count"), "n"))
    parts = cells.unionByName(marks).groupBy("lang", "bucket").applyInPandas(
        _block(top), "lang string, source string, part string, item string, value long, seen long")
    parts = settle(parts, "divergence-parts")

    order = [F.col("value").desc(), F.col("item").cast("binary").asc()]
    terms = (parts.where(F.col("part") == "term")
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
             .where(F.col("rank") <= top).select("lang", "source", "part", "item", "value", "rank"))
    p0 = F.when(F.col("v") > 0, F.lit(1) + F.expr(f"({SCALE}BD * 2) div (n + 2 * v)"))
    a = g.select("lang", "source", "v", p0.alias("p0a"))
    b = g.select("lang", F.col("source").alias("item"), p0.alias("p0b"))
    pairs = a.join(b, "lang").where(F.col("source") != F.col("item"))
    seen = (parts.where(F.col("part") == "pair").groupBy("lang", "source", "item")
            .agg(F.sum("value").alias("sum"), F.sum("seen").alias("seen")))
    zero = F.expr("((p0a - p0b) * (p0a - p0b)) div (p0a + p0b)")
    value = F.when(F.col("v") == 0, F.lit(0)).otherwise(F.coalesce("sum", F.lit(0)) + (F.col("v") - F.coalesce("seen", F.lit(0))) * zero)
    pair_rows = (pairs.join(seen, ["lang", "source", "item"], "left")
                 .select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")))
    pair_rows = pair_rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return pair_rows.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))


CHECK = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
occ AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
gc AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM occ o JOIN kept k USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(gc.c, 0) AS c FROM groups g JOIN kept k USING (lang)
        LEFT JOIN gc USING (lang, source, term)),
gn AS (SELECT lang, source, sum(c) AS n FROM dense GROUP BY ALL),
gp AS (SELECT dense.lang, dense.source, term, c, 1 + ({SCALE}::HUGEINT * (c + 2)) // (n + 2 * v) AS p
        FROM dense JOIN gn USING (lang, source) JOIN v USING (lang)),
ld AS (SELECT lang, term, sum(c) AS c FROM dense GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS n FROM ld GROUP BY ALL),
lp AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (c + 2)) // (n + 2 * v) AS q FROM ld JOIN ln USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source AS source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
pv AS (SELECT pairs.lang, pairs.source, pairs.item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
        FROM pairs LEFT JOIN gp x ON x.lang = pairs.lang AND x.source = pairs.source
        LEFT JOIN gp y ON y.lang = pairs.lang AND y.source = pairs.item AND y.term = x.term GROUP BY ALL),
tv AS (SELECT gp.lang, gp.source, gp.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM gp JOIN lp USING (lang, term)
        WHERE gp.c > 0 AND p > q),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pv
    UNION ALL
    SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM tv)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""


@query("op12_source_divergence", CHECK)
def op12_source_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))
