"""Media columns: bytes stored as lossless WebP images, read back as pixel arrays, and described by features.

A payload is a text's UTF-8 bytes and then bytes 0 up to a positive multiple of 64; null texts count as
empty, so every payload has 64 bytes at least. It is stored as 8-bit palette indices (see ``webp``), one
image for each MiB, one file after the other. Equal texts give equal payloads, media and features.
Repeated rows and extra columns pass through; a name that a step adds must not be among the input's
columns (ValueError). Null media give null pixels and features; media that are no lossless WebP raise
ValueError. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import webp

#: Rows that leave a task in one Arrow batch.
ROWS_OUT = 512


def _map(df: DataFrame, column: str, added: list[tuple[str, T.DataType, pa.DataType]], values) -> DataFrame:
    """``df`` with columns made from each value of ``column`` by ``values``, which returns one value for each."""
    if clash := [n for n, _, _ in added if n in df.columns]:
        raise ValueError(f"the input has columns {clash} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                made = [values(x) for x in part.column(part.schema.get_field_index(column)).to_pylist()]
                new = [pa.array([m[k] for m in made], kind) for k, (_, _, kind) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *[n for n, _, _ in added]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t, _ in added]]))


def stored(df: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """Adds ``into``, the payload of ``text`` as lossless WebP."""

    def values(x: str | None) -> tuple[bytes]:
        data = (x or "").encode()
        return (webp.encode(data + bytes(-len(data) % webp.WIDTH if data else webp.WIDTH)),)

    return _map(df, text, [(into, T.BinaryType(), pa.binary())], values)


def described(images: list[np.ndarray]) -> str:
    """Rows, mean brightness, mean step between neighbours in a row, and different values, of all images together."""
    rows, total, steps, seen = 0, 0, 0, np.zeros(256, np.int64)
    for px in images:
        grey = px[..., 1]
        rows += len(grey)
        total += int(grey.sum(dtype=np.int64))
        steps += int(np.abs(np.diff(grey.astype(np.int16), axis=1)).sum(dtype=np.int64))
        seen += np.bincount(grey.ravel(), minlength=256)
    size = max(1, sum(px.shape[0] * px.shape[1] for px in images))
    return f"rows={rows};mean={1000 * total // size};step={1000 * steps // size};values={np.count_nonzero(seen)}"


def pixels(df: DataFrame, media: str = "media", into: str = "pixels", feature: str = "feature", sizes: str = "sizes", channels: str = "rgba") -> DataFrame:
    """Adds ``into``, the samples of ``channels`` of all pixels of ``media``, pixel by pixel in order, ``sizes``, width and
    height of each of its images, and ``feature``, a description of their green samples."""
    if not channels or set(channels) - set("bgra"):
        raise ValueError(f"channels {channels!r} are not of b, g, r, a")
    places = ["bgra".index(c) for c in channels]
    size = T.ArrayType(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))

    def values(x: bytes | None) -> tuple:
        if x is None:
            return None, None, None
        images = webp.decode(x)
        return b"".join(px[..., places].tobytes() for px in images), [{"width": px.shape[1], "height": px.shape[0]} for px in images], described(images)

    return _map(df, media, [(into, T.BinaryType(), pa.binary()), (sizes, size, pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32())]))), (feature, T.StringType(), pa.string())], values)


def report(docs: DataFrame) -> DataFrame:
    """Per document: what was stored, and what was read back from it."""
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    back = pixels(stored(rows).drop("text"), into="payload", channels="g")  # palette indices are grey: green has all of them
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
