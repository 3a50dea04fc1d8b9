"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are encoded by ``tiktoken``: the rank file maps byte strings to ids, the pattern
splits a text before the merges, and every match is merged on its own. A very long text
is cut first at safe places, and the parts are encoded one after another, which gives the
ids of the whole text. A place is safe when an ASCII letter or digit stands before it and a
space (U+0020) after it: no match of the pattern holds both (letters, digits and marks never
take a blank after them, blanks only blanks), so the matches of the whole text end there,
and the pattern has no look-behind, so the next part is split as in the whole text. The
end of a part is no blank, so the look-ahead ``(?!\\S)`` decides there as in the whole text.

Decoding turns ids back into raw bytes; for a text that was encoded these are its UTF-8
bytes.

Defined results: a null text encodes as the empty text (no ids, empty bytes); empty texts
give no ids; special-token strings in a text are ordinary text. Repeated rows are encoded
each; other columns pass through unchanged, and columns named like the outputs are
replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.llm.registry import query, table

#: Characters of a text above which it is cut at safe places before encoding.
PART_CHARS = 65_536

_SAFE = regex.compile(r"(?<=[A-Za-z0-9]) ")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file (``base64-bytes rank`` per line), no special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(f"ranks-{hashlib.sha1(rank_file.encode()).hexdigest()[:8]}", pat_str=pattern,
                             mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """``text`` cut at safe places into parts of about ``size`` characters; no safe place: one part."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = None
        for m in _SAFE.finditer(text, start + size // 2, start + size):
            cut = m.start()
        if cut is None:
            m = _SAFE.search(text, start + size)
            if m is None:
                break
            cut = m.start()
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


def encode_text(enc, text: str | None, size: int = PART_CHARS) -> list[int]:
    """Ids of a whole text, as ``enc.encode_ordinary`` gives them; null is the empty text."""
    if not text:
        return []
    ids: list[int] = []
    for part in parts(text, size):
        ids.extend(enc.encode_ordinary(part))
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", size: int = PART_CHARS) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of the text and ``decoded`` (binary), the bytes of those ids.

    One Arrow pass: ids are kept as int32 arrays, not Python lists, while a batch is built.
    """
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_bpe_text"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "_bpe_text"]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            coded = [np.asarray(encode_text(enc, t, size), dtype=np.int32) for t in batch.column("_bpe_text").to_pylist()]
            offsets = np.zeros(len(coded) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in coded], out=offsets[1:])
            flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()),
                                           type=pa.list_(pa.field("element", pa.int32(), False)))
            decoded = pa.array([enc.decode_bytes(x.tolist()) for x in coded], pa.binary())
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_bpe_text"]
            yield pa.RecordBatch.from_arrays(columns + [ids, decoded], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def ids_sha256(ids) -> F.Column:
    """Lowercase hex SHA-256 of ids as little-endian unsigned 32-bit integers, in Spark expressions."""

    def little_endian(x):
        h = F.lpad(F.hex(x.cast("long")), 8, "0")
        return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))

    return F.sha2(F.unhex(F.array_join(F.transform(ids, little_endian), "")), 256)


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
