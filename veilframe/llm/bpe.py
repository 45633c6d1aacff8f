"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a leaf is short, each leaf is encoded on its own, and neighbours are joined by
encoding a window around the seam again. The window grows until it begins and ends at a *certain*
boundary, a place where any text, whatever surrounds it, is cut into separate matches: between a
character that is not white space and a following space or line feed. No alternative of the
pre-tokeniser pattern can run over such a place, look past it with another outcome, or depend on
what precedes it, so the tokens outside the window are those of the whole text. Joining is therefore
associative, with the empty list as its unit. Decoding concatenates bytes up the same kind of tree.

Null texts count as empty and give no tokens. Repeated rows, ties and extra columns pass through
unchanged; a name that the result adds must not be among the input's columns (ValueError), and a
pattern under which that boundary isn't proven is refused (ValueError).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a leaf, first width of a window on either side of a seam, ids of a decoding leaf.
LEAF, WINDOW, DECODE_LEAF = 1024, 64, 1024
#: Rows that leave a task in one Arrow batch.
ROWS_OUT = 1024

_CERTAIN = re.compile(r"\S(?=[ \n])")
#: The patterns for which that boundary is proven; in others punctuation may run into a line feed.
PROVEN = (public_tokenizers.PATTERN,)


@lru_cache(maxsize=4)
def _codec(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return encoding, pieces


def _leaf(encoding, text: str) -> np.ndarray:
    return np.asarray(encoding.encode_ordinary(text), dtype=np.int32)


def _before(text: str, low: int, seam: int) -> int:
    """The last certain boundary in (low, seam], or low."""
    width = WINDOW
    while True:
        start = max(low, seam - width)
        found = [m.end() for m in _CERTAIN.finditer(text, start, min(seam + 1, len(text))) if m.end() <= seam]
        if found:
            return found[-1]
        if start == low:
            return low
        width *= 2


def _after(text: str, seam: int, high: int) -> int:
    """The first certain boundary in [seam, high), or high."""
    width = WINDOW
    while True:
        end = min(high, seam + width)
        found = _CERTAIN.search(text, seam - 1, min(end + 1, high))
        if found:
            return found.end()
        if end == high:
            return high
        width *= 2


def encode_text(encoding, text: str, low: int = 0, high: int | None = None) -> np.ndarray:
    """Ids of ``text[low:high]``, by halves joined at their seam."""
    high = len(text) if high is None else high
    if high - low <= LEAF:
        return _leaf(encoding, text[low:high])
    seam = (low + high) // 2
    left, right = encode_text(encoding, text, low, seam), encode_text(encoding, text, seam, high)
    first, last = _before(text, low, seam), _after(text, seam, high)
    if first == last:
        return np.concatenate((left, right))
    keep_left = len(left) - len(_leaf(encoding, text[first:seam])) if first > low else 0
    drop_right = len(_leaf(encoding, text[seam:last])) if last < high else len(right)
    return np.concatenate((left[:keep_left], _leaf(encoding, text[first:last]), right[drop_right:]))


def decode_ids(pieces: list[bytes], ids: list[int]) -> bytes:
    if len(ids) <= DECODE_LEAF:
        return b"".join(map(pieces.__getitem__, ids))
    middle = len(ids) // 2
    return decode_ids(pieces, ids[:middle]) + decode_ids(pieces, ids[middle:])


def _vocabulary(spark: SparkSession, path: str, pattern: str):
    if pattern not in PROVEN:
        raise ValueError("texts can't be halved under this pattern: no boundary is known that it always cuts at")
    with open(path, "rb") as file:  # under 1 MB; read on the driver and broadcast, so executors need no copy
        return spark.sparkContext.broadcast(file.read())


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"the input has a column {name} already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _map(df: DataFrame, column: str, name: str, kind: T.DataType, values) -> DataFrame:
    """``df`` with a column made from ``column`` by ``values``, a function from one Arrow array to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                made = values(part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    return df.mapInArrow(run, _added(df, name, kind))


def _ids(encoding, texts: list[str | None]) -> pa.Array:
    found = [encode_text(encoding, x or "") for x in texts]
    offsets = np.zeros(len(found) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def encode(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """Adds ``into``, the ids of the whole ``text``: those of the tiktoken library without special tokens."""
    held = _vocabulary(df.sparkSession, vocabulary_path, pattern)
    return _map(df, text, into, T.ArrayType(T.IntegerType()), lambda column: _ids(_codec(held.value, pattern)[0], column.to_pylist()))


def count(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Adds ``into``, the number of ids that ``encode`` would give; the ids stay in the task."""
    held = _vocabulary(df.sparkSession, vocabulary_path, pattern)

    def values(column: pa.Array) -> pa.Array:
        encoding, _ = _codec(held.value, pattern)
        return pa.array([len(encode_text(encoding, x or "")) for x in column.to_pylist()], pa.int64())

    return _map(df, text, into, T.LongType(), values)


def decode(df: DataFrame, vocabulary_path: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Adds ``into``, the bytes that ``ids`` stand for (null: none). An id outside the vocabulary raises IndexError."""
    held = _vocabulary(df.sparkSession, vocabulary_path, pattern)

    def values(column: pa.Array) -> pa.Array:
        _, pieces = _codec(held.value, pattern)
        return pa.array([decode_ids(pieces, x or []) for x in column.to_pylist()], pa.binary())

    return _map(df, ids, into, T.BinaryType(), values)


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, token_ids, decoded) of every row: the ids of the whole text and the bytes that these stand for, by one worker a task."""
    held = _vocabulary(docs.sparkSession, vocabulary_path, pattern)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, pieces = _codec(held.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT // 4):
                part = batch.slice(start, ROWS_OUT // 4)
                ids = _ids(encoding, part.column(1).to_pylist())
                back = pa.array([decode_ids(pieces, x) for x in ids.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, back], names=["doc_id", "token_ids", "decoded"])

    kind = rows.schema["doc_id"].dataType
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Per document: number and digest of its ids, and the digest of the bytes decoded from them."""
    return round_trip(docs, vocabulary_path, pattern).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
