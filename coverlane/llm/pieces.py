"""N-best segmentation into SentencePiece pieces, and decoding.

Pieces that fit a text form a lattice. A forward Viterbi pass gives the best score from the
start to every place; searched backward from the end, these scores are exact heuristics, so
A* takes segmentations off its agenda best first. No piece spans two characters that are
neighbours in no piece, so the lattice is cut there into segments, which repeat. Best scores,
worked out for the new segments of many texts at once, give each segment's best segmentation
and how much its second best loses;
the best segmentations of a text differ only at the few places of smallest loss, so A* runs
at these, and their combinations are taken best first.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.llm.registry import query, table

#: A space in the vocabulary's notation. In a text this character is an ordinary one without a piece.
META = "▁"


class Lattice:
    """Pieces with scores, and the search over them.

    A model that scores pieces by merge rank gets the logarithms of Zipf's law instead, so
    that scores add up as log-probabilities do. A character without a piece becomes its
    UTF-8 bytes, at a score below that of every piece.
    """

    #: Longest segment that is searched together with others, and characters of words or segments worked on together.
    short, block = 64, 1 << 16

    def __init__(self, model: bytes, n: int, most: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = {i: sp.get_score(i) for i in plain}
        ranked = all(s == int(s) for s in scores.values())
        bulk = math.log(sum(1 / k for k in range(1, len(plain) + 1)))
        # user-defined pieces have no rank of their own and count as the most frequent
        score = lambda s: (-math.log(max(1.0, 1 - s if s > -1e8 else 1.0)) - bulk) if ranked else s
        self.pieces: dict[str, tuple[float, int] | tuple] = {}
        pairs: set[tuple[str, str]] = set()
        for i in plain:
            text = sp.id_to_piece(i).replace(META, " ")
            pairs.update(itertools.pairwise(text))
            for k in range(1, len(text)):
                self.pieces.setdefault(text[:k], ())  # a beginning only
            self.pieces[text] = (score(scores[i]), i)
        # the pieces by characters: score, id (-1: a beginning only) and what may follow
        self.follow: dict[str, tuple] = {}
        for text, found in sorted(self.pieces.items()):
            level = self.follow
            for c in text[:-1]:
                level = level[c][2]
            level[text[-1]] = (*(found or (0.0, -1)), {})
        self.unknown = min(p[0] for p in self.pieces.values() if p) - 10
        # the same for many segments at once: characters and beginnings by number (0: none), and the
        # next beginning by beginning and character
        chars = sorted({c for text in self.pieces for c in text})
        self.kind, self.kinds = np.zeros(0x110000, np.int32), len(chars) + 1
        self.kind[list(map(ord, chars))] = np.arange(1, self.kinds)
        kind, node = {c: k for k, c in enumerate(chars, 1)}, {"": 0}
        for k, text in enumerate(self.pieces, 1):
            node[text] = k
        self.longest = max(map(len, self.pieces))
        self.steps = pd.Index(np.array([node[text[:-1]] * self.kinds + kind[text[-1]] for text in self.pieces], np.int64))
        self.joint = pd.Index(np.array([kind[a] * self.kinds + kind[b] for a, b in pairs], np.int64))
        self.node_score = np.array([-math.inf, *(found[0] if found else -math.inf for found in self.pieces.values())])
        self.node_piece = np.array([-1, *(found[1] if found else -1 for found in self.pieces.values())], np.int64)
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.n, self.most = n, most
        # Only if nothing but a space can be followed by a space may texts be cut before spaces first.
        spaced = all(b != " " or a == " " for a, b in pairs) and not any("\n" in p for p in pairs)
        self.word = re.compile(r" +[^ \n]*|[^ \n]+|\n" if spaced else r"(?s).+")
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, bytes] = {}
        self.number: dict[str, int] = {}
        self.best, self.gap, self.sizes, self.ids, self.texts = array("d"), array("d"), array("q"), [], []
        self.ranked: dict[int, list[tuple[float, bytes]]] = {}

    def search(self, text: str) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a text, as scores and ids, best first."""
        pieces, size = self.pieces, len(text)
        best, into = [0.0] + [-math.inf] * size, [[] for _ in range(size + 1)]
        for i in range(size):
            here = best[i]
            for j in range(i + 1, size + 1):
                found = pieces.get(text[i:j])
                if found is None:
                    if j == i + 1:
                        into[j].append((i, self.unknown, -1 - i))
                        best[j] = max(best[j], here + self.unknown)
                    break
                if found:
                    score, piece = found
                    into[j].append((i, score, piece))
                    if here + score > best[j]:
                        best[j] = here + score
                elif j == i + 1:  # the beginning of a piece, but none itself
                    into[j].append((i, self.unknown, -1 - i))
                    best[j] = max(best[j], here + self.unknown)
        out, count = [], 0
        agenda = [(-best[size], 0, size, 0.0, None)]
        while agenda and len(out) < self.n:
            total, _, at, done, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path:
                    piece, path = path
                    if piece >= 0:
                        ids.append(piece)
                    else:
                        ids += [self.byte[b] for b in text[-1 - piece].encode("utf-8", "surrogatepass")]
                out.append((-total, ids))
                continue
            for i, score, piece in into[at]:
                count += 1
                heapq.heappush(agenda, (-(best[i] + done + score), count, i, done + score, (piece, path)))
        return out

    def _best(self, text: str) -> tuple[float, float, list[int]]:
        """The best score, what the second best loses against it, and the best ids.

        Any other segmentation leaves the best one at some place by another piece. So the
        loss is the least one among the places of the best segmentation, where each is that
        of the second best way from there to the end.
        """
        size, low = len(text), -math.inf
        rest, loss, ends, ways = [0.0] * (size + 1), [0.0] * size, [0] * size, [0] * size
        for i in range(size - 1, -1, -1):
            first, second, end, way = low, low, i + 1, -1 - i
            level, j = self.follow, i
            for c in text[i:]:
                found = level.get(c)
                if found is None:
                    break
                j += 1
                score, piece, level = found
                if piece >= 0:
                    value = score + rest[j]
                    if value > first:
                        first, second, end, way = value, first, j, piece
                    elif value > second:
                        second = value
                elif j == i + 1:
                    first = self.unknown + rest[j]
            if j == i:
                first = self.unknown + rest[i + 1]
            rest[i], loss[i], ends[i], ways[i] = first, first - second, end, way
        ids, at, least = [], 0, math.inf
        while at < size:
            if loss[at] < least:
                least = loss[at]
            ids.append(ways[at])
            at = ends[at]
        if min(ids) < 0:
            ids = [x for p in ids for x in ((p,) if p >= 0 else [self.byte[b] for b in text[-1 - p].encode("utf-8", "surrogatepass")])]
        return rest[0], least, ids

    def _best_of_all(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """``_best`` of many short segments at once, and which of them hold a character without a piece.

        ``kinds`` are the characters' numbers. The segments, longest first, are columns, the
        places with ``d`` characters to the end are row ``d``. The ids of the odd ones are wrong.
        """
        order = np.argsort(starts - ends, kind="stable")
        ends, sizes = ends[order], (ends - starts)[order]
        deep = int(sizes[0])
        wide = np.searchsorted(-sizes, -np.arange(deep + 1), side="right")  # columns of each row
        row = np.concatenate([[0], np.cumsum(wide)])
        places = np.concatenate([ends[:w] - d for d, w in enumerate(wide.tolist())])
        # the pieces from each place on, by length; a single character always has a score
        alive = np.arange(row[1], len(places))
        at, node = places[alive], np.zeros(len(alive), np.int64)
        scores, nodes = np.full((min(deep, self.longest), len(places)), -np.inf), np.zeros((min(deep, self.longest), len(places)), np.int32)
        for k in range(len(scores)):
            node = self.steps.get_indexer(node * self.kinds + kinds[at]) + 1
            found = np.flatnonzero(node)
            alive, at, node = alive[found], at[found] + 1, node[found]
            scores[k, alive], nodes[k, alive] = self.node_score[node], node
        scores[0][self.node_piece[nodes[0]] < 0] = self.unknown
        rest, loss = np.zeros(len(places)), np.zeros(len(places))
        step, way = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for d in range(1, deep + 1):
            here, w = slice(row[d], row[d + 1]), int(wide[d])
            values = scores[:d, here].copy()
            for k in range(len(values)):
                values[k] += rest[row[d - k - 1] : row[d - k - 1] + w]
            columns, first = np.arange(w), values.argmax(0)  # of equal ones the shortest piece
            rest[here] = values[first, columns]
            values[first, columns] = -np.inf
            loss[here] = rest[here] - values.max(0)
            step[here], way[here] = first + 1, self.node_piece[nodes[first, row[d] + columns]]
        best, least = np.empty(len(order)), np.full(len(order), np.inf)
        best[order] = rest[row[sizes] + np.arange(len(order))]
        # from the start of all segments along their best ways
        column, left, passed, taken = np.arange(len(order)), sizes, [], []
        while len(column):
            at = row[left] + column
            least[order[column]] = np.minimum(least[order[column]], loss[at])
            passed.append(order[column])
            taken.append(way[at])
            left = left - step[at]
            column, left = column[left > 0], left[left > 0]
        counts = np.bincount(np.concatenate(passed), minlength=len(order))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ids, odd = np.empty(bounds[-1], np.int64), np.zeros(len(order), bool)
        for k, (segments, pieces) in enumerate(zip(passed, taken, strict=True)):
            ids[bounds[segments] + k] = pieces
            odd[segments[pieces < 0]] = True
        code, bounds = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
        return best, least, [code[i:j] for i, j in itertools.pairwise(bounds)], odd

    def _learn(self, words: list[str]) -> None:
        """Cuts new words into segments and finds the best way through the new ones, all at once."""
        text = "\0".join([*words, ""])
        breaks = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        kinds = self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        kinds[breaks] = 0
        inside, cut = np.ones(len(kinds), bool), np.ones(len(kinds) + 1, bool)
        inside[breaks] = False
        cut[1:-1] = self.joint.get_indexer(kinds[:-1] * self.kinds + kinds[1:]) < 0
        starts, ends = np.flatnonzero(cut[:-1] & inside), np.flatnonzero(cut[1:] & inside) + 1
        known, number = len(self.ids), self.number
        found = np.array([number.setdefault(text[i:j], len(number)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], np.int32)
        new = np.flatnonzero(found > np.maximum.accumulate(np.concatenate([[known - 1], found[:-1]])))
        starts_new, ends_new, texts = starts[new], ends[new], list(itertools.islice(number, known, None))
        best, gap, ids = np.zeros(len(new)), np.zeros(len(new)), [b""] * len(new)
        odd = ends_new - starts_new > self.short
        short = np.flatnonzero(~odd)
        groups = np.cumsum((ends_new - starts_new)[short]) // self.block
        for part in np.split(short, np.flatnonzero(np.diff(groups)) + 1) if len(short) else ():
            best[part], gap[part], codes, odd[part] = self._best_of_all(kinds, starts_new[part], ends_new[part])
            for k, code in zip(part.tolist(), codes, strict=True):
                ids[k] = code
        for k in np.flatnonzero(odd).tolist():
            best[k], gap[k], way = self._best(texts[k])
            ids[k] = array("I", way).tobytes()
        self.best.frombytes(best.tobytes())
        self.gap.frombytes(gap.tobytes())
        self.sizes.extend(map(len, ids))
        self.ids += ids
        self.texts += texts
        code, bounds = found.tobytes(), (np.searchsorted(starts, breaks) * 4).tolist()
        self.words.update(zip(words, (code[i:j] for i, j in itertools.pairwise([0, *bounds])), strict=True))

    def _ranks(self, number: int) -> list[tuple[float, bytes]]:
        """The ``n`` best of a segment: loss and ids, the best one as stored first."""
        if number not in self.ranked:
            found = [(self.best[number] - s, array("I", ids).tobytes()) for s, ids in self.search(self.texts[number])]
            others = [(max(0.0, loss), ids) for loss, ids in found if ids != self.ids[number]]
            self.ranked[number] = [(0.0, self.ids[number]), *others][: self.n]
        return self.ranked[number]

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a whole text: scores and ids (little-endian unsigned 32 bit)."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None], size: int = 1 << 19) -> Iterator[list[tuple[float, bytes]] | None]:
        """``encode`` of each text, none for none. New words are learnt from about ``size`` characters of texts at a time."""
        held, total = [], 0
        for text in texts:
            held.append(text)
            total += len(text or "")
            if total >= size:
                yield from self._encode_some(held)
                held, total = [], 0
        yield from self._encode_some(held)

    def _encode_some(self, texts: list[str | None]) -> Iterator[list[tuple[float, bytes]] | None]:
        if len(self.words) > self.most:
            self.clear()
        cut = [self.word.findall(" " + text) if text else [] for text in texts]
        new = list(set().union(*cut).difference(self.words))
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        blocks = np.searchsorted(ends, np.arange(0, ends[-1], self.block)).tolist() if new else []
        for i, j in itertools.pairwise([*blocks, len(new)]):
            if i < j:
                self._learn(new[i:j])
        for text, words in zip(texts, cut, strict=True):
            yield self._encode(words) if text else None if text is None else [(0.0, b"")]

    def _encode(self, words: list[str]) -> list[tuple[float, bytes]]:
        segments = np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)
        best = float(np.frombuffer(self.best, np.float64)[segments].sum())
        numbers = segments.tolist()
        codes = [self.ids[i] for i in numbers]
        out = [(best, b"".join(codes))]
        if self.n == 1:
            return out
        first = np.frombuffer(self.gap, np.float64)[segments]
        few = min(self.n - 1, len(first))
        # with n - 1 places of smallest loss at hand, no other place is in the n best
        places = sorted(np.argsort(first, kind="stable")[:few].tolist()) if len(first) < 64 else sorted(self._smallest(first, few))
        choices = [self._ranks(numbers[p]) for p in places]
        # what stands in the best one before, between and after these places
        ends = np.cumsum(np.frombuffer(self.sizes, np.int64)[segments])[places].tolist()
        starts = [end - len(codes[p]) for end, p in zip(ends, places, strict=True)]
        between = [out[0][1][i:j] for i, j in zip([0, *ends], [*starts, None], strict=True)]
        agenda, seen = [], set()

        def push(ranks: tuple[int, ...]) -> None:
            if ranks not in seen and all(r < len(c) for r, c in zip(ranks, choices, strict=True)):
                seen.add(ranks)
                heapq.heappush(agenda, (sum(c[r][0] for r, c in zip(ranks, choices, strict=True)), ranks))

        push((0,) * few)
        while agenda:
            total, ranks = heapq.heappop(agenda)
            if any(ranks):
                changed = [c[r][1] for r, c in zip(ranks, choices, strict=True)]
                out.append((best - total, b"".join(itertools.chain.from_iterable(zip(between, [*changed, b""], strict=True)))))
                if len(out) == self.n:
                    break
            for k in range(few):
                if ranks[k] + 1 < self.n:
                    push((*ranks[:k], ranks[k] + 1, *ranks[k + 1 :]))
        return out

    @staticmethod
    def _smallest(values: np.ndarray, few: int) -> list[int]:
        """Places of the smallest values, the earlier one of equal ones."""
        edge = np.partition(values, few - 1)[few - 1]
        below = np.flatnonzero(values < edge).tolist()
        return below + np.flatnonzero(values == edge)[: few - len(below)].tolist()


def _with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


SEGMENTATIONS = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.BinaryType())]))
_ARROW = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))


def encode(docs: DataFrame, model: bytes, n: int = 3, out_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``segmentations``: the ``n`` best of ``text``, best first, with score and ids.

    ``model`` is a SentencePiece model file's bytes. Ids are little-endian unsigned 32-bit
    numbers. A text with fewer segmentations has fewer; an empty text has one without ids, a
    null text has null. Equal scores come in a fixed order. Repeated rows stay; a column of
    that name is replaced; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one file of fixed size
    docs = docs.drop("segmentations")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value, n)
        for batch in batches:
            start, held, size = 0, [], 0
            for k, found in enumerate(lattice.encode_all(text.as_py() for text in batch.column(at)), 1):
                held.append(None if found is None else [{"score": s, "ids": i} for s, i in found])
                size += sum(len(x["ids"]) for x in held[-1] or ())
                if size > out_bytes or k == batch.num_rows:
                    yield _with_columns(batch.slice(start, k - start), segmentations=pa.array(held, _ARROW))
                    start, held, size = k, [], 0

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("segmentations", SEGMENTATIONS)]))


def decode(rows: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of a column of binary ids; null ids give null. Undoes ``encode`` exactly.

    Byte pieces that form no UTF-8 become replacement characters; control pieces are empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop(out)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=shared.value)
        pieces = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i)
                  else sp.id_to_piece(i).replace(META, " ").encode() for i in range(sp.get_piece_size())]
        for batch in batches:
            texts = []
            for code in batch.column(at):
                code = code.as_py()
                texts.append(None if code is None else b"".join(map(pieces.__getitem__, np.frombuffer(code, "<u4").tolist())).decode("utf-8", "replace").removeprefix(" "))
            yield _with_columns(batch, **{out: pa.array(texts, pa.string())})

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def model_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


#: The file name of the vocabulary that the query uses.
MODEL = "piece_bpe_32k.model"


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf_dir):
    import public_tokenizers

    model = model_file(public_tokenizers.path(MODEL))
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    best = coded.withColumns({"ids": F.get("segmentations", F.lit(0))["ids"], "scores": F.transform("segmentations", lambda s: s["score"]),
                              "ids_crc32": F.transform("segmentations", lambda s: F.crc32(s["ids"]))}).drop("segmentations")
    return decode(best, model).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "scores", "ids_crc32",
        F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull()).alias("round_trip"))
