"""Fill-in-the-middle: texts cut in three at two places, and put together again as prefix, suffix, middle.

A text's UTF-8 bytes fall into classes (see ``CLASSES``), whose sequence a wavelet matrix holds: for each of the three
bits of a class one bit vector with counts, so that the number of a class's bytes before any place is three counts of
bits. A unit begins at every byte of certain classes (a code point at every byte but a continuation, a word at each
first byte after white space, a line after each line end), so the units before a place are a sum of such ranks, or what
the ranks of the other classes leave. Both cuts are found by bisection on these sums; neither the text nor its
units are listed. Memory is a few bytes for each byte of one text.

Where the cuts fall, and which form a document takes, follows from a digest of its id: reruns agree, wherever a task
runs. Forms: ``plain`` keeps the text (empty texts, texts that hold a mark, and a share of the others); ``psm`` and
``spm`` put marks between the parts, from which ``restored`` has the exact text again, since no text holds a mark.

Null texts count as empty; a null id takes the digest of an empty one. Repeated rows have equal results. An empty table
gives none. Bytes that are no UTF-8 are cut at the places where a code point would begin. Only the id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, "1:"

#: Classes of bytes: the rest of a code point, white space, a line's first byte, a word's first byte within a line, another first byte.
CONTINUATION, SPACE, LINE, WORD, INNER = CLASSES = range(5)
LINE_WORD = 5  # a line's first byte that begins a word too
LEVELS = 3
#: The classes whose bytes begin a unit.
UNITS = {"char": (SPACE, LINE, WORD, INNER, LINE_WORD), "word": (WORD, LINE_WORD), "line": (LINE, LINE_WORD)}


def classes(data: bytes) -> np.ndarray:
    """The class of each byte."""
    b = np.frombuffer(data, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    after_space, after_line = np.ones(len(b), bool), np.ones(len(b), bool)
    after_space[1:], after_line[1:] = space[:-1], b[:-1] == 10
    word = ~space & after_space
    out = np.full(len(b), INNER, np.uint8)
    out[space] = SPACE
    out[word] = WORD
    out[after_line] = LINE
    out[after_line & word] = LINE_WORD
    out[(b & 0xC0) == 0x80] = CONTINUATION
    return out


class Bits:
    """A bit vector: ``ones(i)`` are set among the first i."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(8 + -len(packed) % 8, np.uint8))).view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: int) -> int:
        return int(self.before[i >> 6]) + (int(self.words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()


class WaveletMatrix:
    """Ranks of the values below 2 ** ``levels`` in a sequence, by one bit vector a level: zeros of a level come first in the next."""

    def __init__(self, values: np.ndarray, levels: int = LEVELS):
        self.n, self.bits, self.zeros = len(values), [], []
        for level in reversed(range(levels)):
            bit = (values >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))
        #: Where each value's run begins after the last level.
        self.start = [self._place(v, 0) for v in range(1 << levels)]

    def _place(self, value: int, i: int) -> int:
        top = len(self.bits) - 1
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.ones(i)
            i = zeros + ones if value >> (top - k) & 1 else i - ones
        return i

    def rank(self, value: int, i: int) -> int:
        """How many of the first ``i`` are ``value``."""
        return self._place(value, i) - self.start[value]


class Units:
    """The units of one text: how many begin before a place, and where the k-th ends."""

    def __init__(self, data: bytes, unit: str = "char"):
        self.data, self.matrix = data, WaveletMatrix(classes(data))
        inside, outside = UNITS[unit], [c for c in (*CLASSES, LINE_WORD) if c not in UNITS[unit]]
        self.left = len(outside) < len(inside)  # fewer ranks to add
        self.asked = outside if self.left else inside
        self.n = self.begun(len(data))

    def begun(self, i: int) -> int:
        """How many units begin within the first ``i`` bytes."""
        ranks = sum(self.matrix.rank(c, i) for c in self.asked)
        return i - ranks if self.left else ranks

    def end(self, k: int) -> int:
        """The byte at which the first ``k`` units end: where the next one begins, or the end of the text."""
        if k >= self.n:
            return len(self.data)
        if k <= 0:
            return 0
        low, high = k, len(self.data)  # the least place before which more than k units have begun
        while low < high:
            middle = (low + high) // 2
            if self.begun(middle) > k:
                high = middle
            else:
                low = middle + 1
        return low - 1


def numbers(doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{SEED}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(data: bytes, doc_id: int | None, unit: str = "char") -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, bytes of prefix and middle (null if plain), and the output of one text."""
    units = Units(data, unit)
    h1, h2, h3, h4 = numbers(doc_id)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not data or p in data or s in data or m in data or h3 % 100 >= PLAIN_FROM:
        return units.n, "plain", None, None, data
    one, two = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    i, j = units.end(one), units.end(two)
    if h4 % 100 < SPM_BELOW:
        return units.n, "spm", i, j - i, s + data[j:] + p + data[:i] + m + data[i:j]
    return units.n, "psm", i, j - i, p + data[:i] + s + data[j:] + m + data[i:j]


def fill_in_middle(docs: DataFrame, unit: str = "char", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) of every row: number of units, the parts (null if plain) and the text to train on."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [transformed(data, i, unit) for i, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds)]], names=["doc_id", "n", "form", "i", "j", "output"])

    found = rows.mapInArrow(run, "doc_id long, n long, form string, i long, j long, output binary")
    first = F.length(F.lit(PREFIX)) + 1
    spm, mark = F.col("form") == "spm", 3
    total = F.length("output") - 3 * mark  # bytes of the text, unless plain
    rest = total - F.col("i") - F.col("j")
    cut = lambda start, size: F.when(F.col("form") != "plain", F.substring("output", start, size).cast("string"))
    return found.select(
        "doc_id",
        "n",
        "form",
        cut(F.when(spm, first + rest + mark).otherwise(first), F.col("i").cast("int")).alias("prefix"),
        cut(F.length("output") - F.col("j") + 1, F.col("j").cast("int")).alias("middle"),
        cut(F.when(spm, first).otherwise(first + F.col("i") + mark), rest.cast("int")).alias("suffix"),
        F.col("output").cast("string").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output and its form: the marks are found from the left, as no part holds one."""
    second = F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    i, j = F.position(second, output), F.position(F.lit(MIDDLE), output)
    one, two = F.substring(output, 4, i - 4), F.substring(output, i + 3, j - i - 3)
    middle = F.substring(output, j + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row, in code points."""
    made = fill_in_middle(docs, "char", doc_id, text)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    sha = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, length(t) AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(0, 4)] AS h FROM hashed),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, i) AS p, substr(t, i + 1, j - i) AS m, substr(t, j + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
