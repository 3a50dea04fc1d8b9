"""Vector bin packing of tokenized examples into training sequences.

An example is a vector: its tokens, one segment, its loss-bearing tokens. A sequence has a
limit for each. The dot-product heuristic fills one sequence at a time with the example
whose vector points best along what is left of it; where nothing fits any more, an example
is cut. Each task packs the rows of its own partition with a bounded pool of waiting
examples, so nothing is shuffled and only the last sequences of a task stay short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from coverlane.llm.registry import query, table

class Encoder:
    """Ids of a text by a ``tokenizers`` tokenizer that ignores case and never reads across white space.

    Words repeat, so each is encoded once and its ids are kept as bytes (little-endian
    unsigned 32 bit); the store is emptied when it holds ``most`` words. A word of letters and
    the punctuation behind it are always tokens apart. Strings of special tokens in a text
    are ordinary text.
    """

    def __init__(self, spec: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.model, self.most, self.known = self.tokenizer.model, most, {}

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
        if len(self.known) > self.most:
            self.known.clear()
        if new := set(words).difference(self.known):
            self._learn(new)
        return b"".join(map(self.known.__getitem__, words))

    def _learn(self, words: set[bytes]) -> None:
        known, slow, parts = self.known, [], {}
        for word in words:
            core = word.rstrip(b".,!?;:")
            parts[word] = (core, word[len(core) :]) if core != word and core[-1:].isalnum() else (word,)
        for part in {p for pair in parts.values() for p in pair}.difference(known):
            if part.isalpha():  # ASCII letters: one piece for the model
                known[part] = np.array([t.id for t in self.model.tokenize(part.decode())], "<u4").tobytes()
            else:
                slow.append(part)
        if slow:
            texts = [p.decode("utf-8", "replace") for p in slow]
            code = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            owner = np.searchsorted(starts, [at for at, _ in code.offsets], "right") - 1
            ids, ends = np.array(code.ids, "<u4"), np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, part in enumerate(slow):
                known[part] = ids[ends[i] : ends[i + 1]].tobytes()
        for word, pair in parts.items():
            if len(pair) > 1:
                known[word] = known[pair[0]] + known[pair[1]]


def word_bounded(spec: str) -> bool:
    """Whether the tokenizer ignores case, splits at white space and before punctuation, and drops white space."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    samples = ["a", "Don't", "x1.", "Über-", "...", "é", "Σς", "́b", "'s", "!?", "漢字"]
    return all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for a in samples for b in samples for gap in (" ", "\n", " \t\n ")) and ids("ABC") == ids("abc") and ids("abc.") == ids("abc") + ids(".")


class Packer:
    """Sequences from examples that come one by one.

    ``add`` and ``finish`` yield (example number, start, length, sequence, offset). An
    example over a whole sequence gives full sequences of its own first; the rest waits.
    """

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = 512):
        self.limit = np.array([tokens, segments, loss], float)
        self.pool, self.sequence = pool, 0
        self.vectors = np.zeros((pool, 3))
        self.place = np.zeros((pool, 2), np.int64)  # example, start
        self.n = 0
        self.used = self.weight = np.ones(3)

    def add(self, example: int, tokens: int, loss: int) -> Iterator[tuple[int, int, int, int, int]]:
        whole, start = int(min(self.limit[0], self.limit[2] if loss else self.limit[0])), 0
        while tokens - start > whole:
            yield example, start, whole, self.sequence, 0
            self.sequence += 1
            start += whole
        rest = tokens - start
        # loss tokens are spread evenly over an example, as far as its pieces are concerned
        self._wait(example, start, rest, -(-loss * rest // tokens) if tokens else 0)
        if self.n == self.pool:
            yield from self._fill()

    def finish(self) -> Iterator[tuple[int, int, int, int, int]]:
        while self.n:
            yield from self._fill()

    def _wait(self, example: int, start: int, tokens: int, loss: int) -> None:
        self.vectors[self.n] = tokens, 1, loss
        self.place[self.n] = example, start
        self.used = self.used + self.vectors[self.n] / self.limit  # what is asked for most weighs most
        self.n += 1

    def _take(self, k: int) -> None:
        self.n -= 1
        self.vectors[k], self.place[k] = self.vectors[self.n], self.place[self.n]

    def _fill(self) -> Iterator[tuple[int, int, int, int, int]]:
        """One sequence."""
        left, offset = self.limit.copy(), 0
        weight = self.used / self.used.sum() / self.limit**2
        while self.n:
            v = self.vectors[: self.n]
            fits = (v <= left).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, v @ (weight * left), -1.0)))
                tokens = int(v[k, 0])
            elif left[0] >= 1 and left[1] >= 1 and (room := self._room(left)):
                k = int(np.argmax(v[:, 0]))
                tokens = min(room, int(v[k, 0]) - 1)
            else:
                break
            example, start = (int(x) for x in self.place[k])
            yield example, start, tokens, self.sequence, offset
            offset += tokens
            loss = v[k, 2] if tokens == v[k, 0] else min(v[k, 2], np.ceil(v[k, 2] * tokens / v[k, 0]))
            left -= (tokens, 1, loss)
            if tokens == v[k, 0]:
                self._take(k)
            else:
                self.vectors[k] -= (tokens, 0, loss)
                self.place[k, 1] += tokens
        self.sequence += 1

    def _room(self, left: np.ndarray) -> int:
        """Tokens of the longest waiting example that still fit."""
        v = self.vectors[int(np.argmax(self.vectors[: self.n, 0]))]
        share = v[2] / v[0]
        room = int(left[0]) if share == 0 else int(min(left[0], np.floor(left[2] / share)))
        return room if 1 <= room < v[0] and np.ceil(v[2] * room / v[0]) <= left[2] else 0


PIECES = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                       T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(docs: DataFrame, spec: str, end: int, tokens: int = 2048, segments: int = 256, loss: int = 2048,
         with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (``doc_id, text``) in sequences; other columns are left out.

    ``spec`` is the JSON of a tokenizer, ``end`` the id that closes each document; every token
    bears loss. A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``, with ``ids`` too if asked for. A null or empty text is one token; repeated rows
    are packed apart; no rows give none. A sequence lies in one task: its id is the task's
    partition times 2**32 plus a count.
    """
    if not word_bounded(spec):
        raise ValueError("this tokenizer reads across white space")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *PIECES.fields,
                           *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one file of fixed size
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(shared.value), Packer(tokens, segments, loss)
        base = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}  # example: id, bytes, tokens not placed yet
        out: list[tuple] = []

        def placed(pieces) -> None:
            for example, start, length, sequence, offset in pieces:
                entry = waiting[example]
                ids = entry[1][4 * start : 4 * (start + length)]
                row = (entry[0], start, length, zlib.crc32(ids), len(entry[1]) // 4, base + sequence, offset)
                out.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row)
                entry[2] -= length
                if not entry[2]:
                    del waiting[example]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
            out.clear()
            return made

        kinds, n = None, 0
        for rows in batches:
            kinds = kinds or [rows.schema.field(0).type, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if with_ids else [])]
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                ids = encode(text.as_py()) + closing
                waiting[n] = [doc_id, ids, len(ids) // 4]
                placed(packer.add(n, len(ids) // 4, len(ids) // 4))
                n += 1
                if len(out) >= 10_000:
                    yield batch()
        placed(packer.finish())
        if out:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def tokenizer_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


#: Fixed values of the packing contract: the tokenizer's file and the id that closes a document.
TOKENIZER, END = "word_bpe_49k.json", 1


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, tokenizer_spec(public_tokenizers.path(TOKENIZER)), END)


@query("op4_packing")
def op4_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
