"""Lossless WebP (VP8L), as its public specification states it: a decoder for any stream, and an encoder of bytes.

Decoding reads prefix codes, back-references, the colour cache and groups of codes, then inverts the
predictor, cross-colour, subtract-green and palette transforms; the result is a pixel array of shape
(height, width, 4) in the order blue, green, red, alpha. Images whose pixels differ in one channel
alone take a quicker way: a table that gives several symbols for the next 16 bits.

The encoder stores bytes as the palette indices of an image 64 pixels wide, with a fixed prefix code
for text, repeated lines and runs of padding as back-references. Equal bytes give equal streams.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR, SIGNATURE = 0x1E35A7BD, 0x2F
WIDTH, MOST_ROWS = 64, 16_384


def code_lengths(weights: list[int]) -> list[int]:
    """Lengths of a complete prefix code for positive weights (0: no code), by Huffman's rule, ties by symbol."""
    heap = [(w, i, (i,)) for i, w in enumerate(weights) if w]
    lengths = [0] * len(weights)
    if len(heap) == 1:
        lengths[heap[0][1]] = 1
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    return lengths


def codes(lengths: list[int]) -> list[int]:
    """Canonical codes, bits reversed, as the stream has them from the lowest bit on."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = int(format(code, f"0{n}b")[::-1], 2)
        code += 1
    return out


@lru_cache(maxsize=256)
def _lookup(lengths: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """For the next 15 bits: symbol, and its length (0 if the code has one symbol only)."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return [used[0]] * (1 << 15), [0] * (1 << 15)
    if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
        raise ValueError("a prefix code is not complete")
    symbol, size = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
    for s, (code, n) in enumerate(zip(codes(list(lengths)), lengths, strict=True)):
        if n:
            symbol[code :: 1 << n], size[code :: 1 << n] = s, n
    return symbol.tolist(), size.tolist()


@lru_cache(maxsize=16)
def _several(lengths: tuple[int, ...]) -> tuple[list[bytes], list[int], int]:
    """For the next 16 bits: as many literals as they hold entirely, and their bits; none if the first symbol is no literal. Also the most literals."""
    symbol, size = (np.array(x) for x in _lookup(lengths))
    bits = np.arange(1 << 16)
    at, going = np.zeros(1 << 16, np.int64), np.ones(1 << 16, bool)
    found: list[bytearray] = [bytearray() for _ in range(1 << 16)]
    while going.any():
        peek = (bits >> at) & 0x7FFF
        s, n = symbol[peek], size[peek]
        going &= (s < 256) & (at + n <= 16) & (n > 0)
        for i in np.flatnonzero(going).tolist():
            found[i].append(s[i])
        at[going] += n[going]
    return [bytes(x) for x in found], at.tolist(), max(1, max(map(len, found)))


class _Bits:
    """Reads up to 24 bits at a time, lowest first."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        self.words = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24).tolist()
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        value = (self.words[self.at >> 3] >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return value

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        peek = (self.words[self.at >> 3] >> (self.at & 7)) & 0x7FFF
        self.at += table[1][peek]
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return table[0][peek]


#: Codes read lately, by alphabet and place in a byte: (bits, their value, lengths). What the same bits say needs no second reading.
_LATELY: dict[tuple[int, int], list[tuple[int, int, tuple[int, ...]]]] = {}


def _read_lengths(bits: _Bits, alphabet: int) -> tuple[int, ...]:
    def value(start: int, n: int) -> int:
        return (int.from_bytes(bits.data[start >> 3 : (start + n + 7) >> 3], "little") >> (start & 7)) & ((1 << n) - 1)

    known, start = _LATELY.setdefault((alphabet, bits.at & 7), []), bits.at
    for n, same, lengths in known:
        if start + n <= bits.end and value(start, n) == same:
            bits.at += n
            return lengths
    lengths = _parse_lengths(bits, alphabet)
    known.insert(0, (bits.at - start, value(start, bits.at - start), lengths))
    del known[8:]
    return lengths


def _parse_lengths(bits: _Bits, alphabet: int) -> tuple[int, ...]:
    lengths = [0] * alphabet
    if bits.read(1):
        second = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if second:
            lengths[bits.read(8)] = 1
        return tuple(lengths)
    own = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    table = _lookup(tuple(own))
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and tokens:
        tokens -= 1
        s = bits.symbol(table)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            value, n = {16: (last, 3), 17: (0, 3), 18: (0, 11)}[s]
            n += bits.read({16: 2, 17: 3, 18: 7}[s])
            if at + n > alphabet:
                raise ValueError("code lengths run over their alphabet")
            lengths[at : at + n] = [value] * n
            at += n
    return tuple(lengths)


def _extra(bits: _Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out, distance: int, n: int) -> None:
    start = len(out) - distance
    if start < 0:
        raise ValueError("a back-reference begins before the image")
    if distance >= n:
        out += out[start : start + n]
    else:
        piece = out[start:]
        out += (piece * (n // distance + 1))[:n]


def _read_image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB integers, shape (height, width)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, group_of, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        entropy = _read_image(bits, -(-width >> shift), -(-height >> shift), False)
        group_of = ((entropy >> 8) & 0xFFFF).astype(int).tolist()
        groups = max(map(max, group_of)) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    lengths = [[_read_lengths(bits, n) for n in sizes] for _ in range(groups)]
    total, single = width * height, lambda x: sum(map(bool, x)) == 1
    if not cache_bits and groups == 1 and all(map(single, lengths[0][1:4])) and not single(lengths[0][0]):
        green = _read_one_channel(bits, lengths[0], width, total)
        rest = [x.index(1) for x in lengths[0][1:4]]
        return (np.frombuffer(green, np.uint8).astype(np.uint32) << 8 | (rest[2] << 24 | rest[0] << 16 | rest[1])).reshape(height, width)
    tables = [[_lookup(x) if any(x) else None for x in group] for group in lengths]
    out: list[int] = []
    cache, entered = [0] * (1 << cache_bits), 0
    while len(out) < total:
        at = len(out)
        own = tables[group_of[(at // width) >> shift][(at % width) >> shift]] if group_of else tables[0]
        s = bits.symbol(own[0])
        if s < 256:
            red, blue, alpha = bits.symbol(own[1]), bits.symbol(own[2]), bits.symbol(own[3])
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = _extra(bits, s - 256)
            _copy(out, _distance(_extra(bits, bits.symbol(own[4])), width), min(n, total - at))
        else:
            while entered < at:
                cache[(CACHE_FACTOR * out[entered] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[entered]
                entered += 1
            out.append(cache[s - 280])
    return np.array(out, np.uint32).reshape(height, width)


def _read_one_channel(bits: _Bits, lengths, width: int, total: int) -> bytearray:
    literals, used, most = _several(lengths[0])
    table, distances = _lookup(lengths[0]), _lookup(lengths[4]) if any(lengths[4]) else None
    words, at, out = bits.words, bits.at, bytearray()
    while (left := total - len(out)) > 0:
        plain = left >= most
        for _ in range(left // most):  # so many steps can't pass the end
            peek = (words[at >> 3] >> (at & 7)) & 0xFFFF
            n = used[peek]
            if not n:
                plain = False
                break
            out += literals[peek]
            at += n
        if plain:
            continue
        bits.at = at
        s = bits.symbol(table)
        if s < 256:
            out.append(s)
        else:
            n = _extra(bits, s - 256)
            _copy(out, _distance(_extra(bits, bits.symbol(distances)), width), min(n, total - len(out)))
        at = bits.at
    bits.at = at
    if at > bits.end:
        raise ValueError("the stream ends early")
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(*argb.shape, 4)


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, right, corner):
    if mode == 11:
        nearer = np.abs(top - corner).sum(axis=-1) < np.abs(left - corner).sum(axis=-1)
        return np.where(nearer[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        return np.clip(mean + ((mean - corner) / 2).astype(np.int32), 0, 255)
    plain = {1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: _average(_average(left, right), top), 6: lambda: _average(left, corner), 7: lambda: _average(left, top), 8: lambda: _average(corner, top), 9: lambda: _average(top, right), 10: lambda: _average(_average(left, corner), _average(top, right))}
    return plain[mode]() if mode in plain else np.array([0, 0, 0, 255], np.int32)


def _undo_predictor(px: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    """Pixels from their differences. A pixel needs its left neighbour and three of the row above, so all pixels with one
    column plus twice the row are undone at once: width + 2 x height steps instead of one for each pixel."""
    height, width, _ = px.shape
    out = px.astype(np.int32)
    out[0, 0, 3] += 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    out[:, 0] = np.cumsum(out[:, 0], axis=0) & 255
    for wave in range(3, width + 2 * height - 2):
        y = np.arange(max(1, (wave - width + 2) // 2), min(height - 1, (wave - 1) // 2) + 1)
        x = wave - 2 * y
        left, top, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
        last = x + 1 == width  # there the first pixel of the same row stands for the upper right one
        right = out[np.where(last, y, y - 1), np.where(last, 0, x + 1)]
        mode = modes[y >> bits, x >> bits]
        for m in np.unique(mode):
            at = mode == m
            out[y[at], x[at]] = (out[y[at], x[at]] + _predict(int(m), left[at], top[at], right[at], corner[at])) & 255
    return out.astype(np.uint8)


def _undo_cross_colour(px: np.ndarray, bits: int, factors: np.ndarray) -> np.ndarray:
    height, width, _ = px.shape
    wide = factors.repeat(1 << bits, 0)[:height].repeat(1 << bits, 1)[:, :width].view(np.int8).astype(np.int32)
    out, signed = px.astype(np.int32), lambda c: (c & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(out[..., 1])
    out[..., 2] += (wide[..., 0] * green) >> 5
    out[..., 0] += ((wide[..., 1] * green) >> 5) + ((wide[..., 2] * signed(out[..., 2])) >> 5)
    return (out & 255).astype(np.uint8)


def _undo_palette(px: np.ndarray, width: int, shift: int, colours: np.ndarray) -> np.ndarray:
    index = px[..., 1]
    if shift:
        n = 8 >> shift
        index = ((index[:, :, None] >> (n * np.arange(1 << shift))) & ((1 << n) - 1)).reshape(len(px), -1)[:, :width]
    table = np.zeros((256, 4), np.uint8)
    table[: len(colours)] = colours
    return table[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """The pixels of one VP8L stream."""
    bits = _Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a VP8L stream")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform appears twice")
        seen.add(kind)
        if kind in (0, 1):
            size = bits.read(3) + 2
            block = _channels(_read_image(bits, -(-now >> size), -(-height >> size), False))
            undo.append((lambda px, s=size, b=block: _undo_predictor(px, s, b[..., 1] & 15)) if kind == 0 else (lambda px, s=size, b=block: _undo_cross_colour(px, s, b)))
        elif kind == 2:
            undo.append(lambda px: np.stack((px[..., 0] + px[..., 1], px[..., 1], px[..., 2] + px[..., 1], px[..., 3]), axis=-1))
        else:
            n = bits.read(8) + 1
            colours = np.cumsum(_channels(_read_image(bits, n, 1, False))[0].astype(np.int64), axis=0).astype(np.uint8)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda px, w=now, s=shift, c=colours: _undo_palette(px, w, s, c))
            now = -(-now >> shift)
    px = _channels(_read_image(bits, now, height, True))
    for step in reversed(undo):
        px = step(px)
    return px


def decode(data: bytes) -> list[np.ndarray]:
    """The pixel arrays of one or more WebP files that follow each other."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        n = int.from_bytes(data[at + 16 : at + 20], "little")
        out.append(decode_vp8l(data[at + 20 : at + 20 + n]))
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    return out


def _file(stream: bytes) -> bytes:
    padded = stream + bytes(len(stream) % 2)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + padded


def pack(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of up to 24 bits each, one after the other, lowest bits first."""
    ends = np.cumsum(sizes)
    at = ends - sizes
    shifted, first = values.astype(np.int64) << (at & 7), at >> 3
    n = int(ends[-1] + 7) // 8 if len(ends) else 0
    out = np.zeros(n + 4)
    for k in range(4):
        out += np.bincount(first + k, weights=(shifted >> (8 * k)) & 255, minlength=n + 4)
    return out[:n].astype(np.uint8).tobytes()


def prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number, of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    half = (value - 1) >> n & 1
    return 2 * n + 2 + half, (value - 1) & ((1 << n) - 1), n


def write_lengths(lengths: list[int]) -> list[tuple[int, int]]:
    """The bits of one prefix code: simple for one or two symbols below 256, else all lengths, runs of zeros shortened."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and used[-1] < 256:
        return [(1, 1), (len(used) - 1, 1), (1, 1), *[(s, 8) for s in used]]
    tokens, at = [], 0
    while at < len(lengths):
        n = next((k for k, x in enumerate(lengths[at : at + 138]) if x), len(lengths[at : at + 138]))
        if n < 3:
            tokens.append((lengths[at], 0, 0))
            at += 1
        else:
            tokens.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            at += n
    kinds = sorted({t[0] for t in tokens})
    own = [0] * 19
    for s, n in zip(kinds, code_lengths([1] * len(kinds)), strict=True):
        own[s] = n
    table, single = codes(own), len(kinds) == 1
    out = [(0, 1), (15, 4), *[(own[k], 3) for k in CODE_LENGTH_ORDER], (0, 1)]
    for s, more, k in tokens:
        out += [(table[s], 0 if single else own[s]), (more, k)]
    return out


def _text_weight(b: int) -> int:
    if b in b" e":
        return 96
    if b in b"atinorsh":
        return 48
    if b in b"dlucmgbp\n,.":
        return 16
    return 8 if 97 <= b <= 122 else 4 if b in b"%$&*#!|\xc3" else 2 if 32 <= b < 128 or b >= 0x80 else 1


GREEN = code_lengths([_text_weight(b) for b in range(256)] + [2] * 24)
DISTANCE = code_lengths([1] * 40)
_GREEN_CODE, _DISTANCE_CODE = codes(GREEN), codes(DISTANCE)
_LITERAL, _LITERAL_SIZE = np.array(_GREEN_CODE[:256]), np.array(GREEN[:256])


def _match(n: int, distance_code: int) -> list[tuple[int, int]]:
    s, e, k = prefix(n)
    d, f, m = prefix(distance_code)
    return [(_GREEN_CODE[256 + s], GREEN[256 + s]), (e, k), (_DISTANCE_CODE[d], DISTANCE[d]), (f, m)]


@lru_cache(maxsize=1)
def _head() -> np.ndarray:
    """All bits before the pixels of an image of one row: size, a palette of 256 greys (a first colour, then equal steps), prefix codes."""
    one = lambda s: [int(x == s) for x in range(256)]
    step = [1 if x in (0, 1) else 0 for x in range(256)]
    alpha = [1 if x in (0, 255) else 0 for x in range(256)]
    green = [2 if x in (0, 1) else 0 for x in range(256)] + [0] * 24
    long, more, k = prefix(254)
    green[256 + long], reach = 1, [1, 1] + [0] * 38
    code, distance = codes(green), codes(reach)
    two = lambda lengths, s: (codes(lengths)[s], 1)
    palette = [(code[0], green[0]), two(step, 0), two(step, 0), two(alpha, 255), (code[1], green[1]), two(step, 1), two(step, 1), two(alpha, 0)]
    palette += [(code[256 + long], green[256 + long]), (more, k), (distance[1], 1)]  # distance code 2: the pixel before
    out = [(SIGNATURE, 8), (WIDTH - 1, 14), (0, 14), (0, 1), (0, 3), (1, 1), (3, 2), (255, 8), (0, 1)]
    for lengths in (green, step, step, alpha, reach):
        out += write_lengths(lengths)
    out += [*palette, (0, 1), (0, 1), (0, 1)]  # no more transforms, no cache, one group
    for lengths in (GREEN, one(0), one(0), one(255), DISTANCE):
        out += write_lengths(lengths)
    return np.array(out)


def _matches(data: bytes, width: int = WIDTH, least: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, distance code) of lines that came before, and of runs of padding at the end."""
    seen: dict[bytes, int] = {}
    out, at, end = [], 0, len(data.rstrip(b"\0"))
    for line in data[:end].split(b"\n"):
        n = len(line)
        if n >= least:
            if (before := seen.setdefault(line, at)) != at:
                for k in range(0, n, 4096):
                    out.append((at + k, min(4096, n - k), at - before + 120))
        at += n + 1
    if len(data) - end > 4:
        for k in range(end + 1, len(data), 4096):
            out.append((k, min(4096, len(data) - k), 2))
    return [m for m in out if m[1] > 3]


def encode(payload: bytes) -> bytes:
    """Lossless WebP files, one for each MiB, whose palette indices are ``payload`` (a positive multiple of 64 bytes)."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"not a positive multiple of {WIDTH} bytes")
    files = []
    for start in range(0, len(payload), WIDTH * MOST_ROWS):
        data = payload[start : start + WIDTH * MOST_ROWS]
        raw = np.frombuffer(data, np.uint8)
        head = _head().copy()
        head[2, 0] = len(data) // WIDTH - 1
        parts, at = [head], 0
        for where, n, code in _matches(data):
            parts += [np.stack((_LITERAL[raw[at:where]], _LITERAL_SIZE[raw[at:where]]), axis=1), np.array(_match(n, code))]
            at = where + n
        parts.append(np.stack((_LITERAL[raw[at:]], _LITERAL_SIZE[raw[at:]]), axis=1))
        both = np.concatenate(parts)
        files.append(_file(pack(both[:, 0], both[:, 1])))
    return b"".join(files)
