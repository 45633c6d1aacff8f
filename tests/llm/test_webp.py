import hashlib
import zlib

import numpy as np
import pytest

from veilframe.llm import media, webp


class Writer:
    """Writes streams that use what the library's encoder does not, in the plainest way."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]

    def pairs(self, pairs):
        for value, n in pairs:
            self.put(value, n)

    def image(self, argb, width, cache=0, groups=None, backrefs=()):
        """argb: flat integers; backrefs: {start: (length, distance)}; groups: (shift, rows of group numbers)."""
        main = groups is not None
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        if main:
            shift, of = groups
            self.put(1 if of else 0, 1)
            if of:
                self.put(shift - 2, 3)
                self.image([g << 8 for row in of for g in row], len(of[0]))
        n = max(map(max, groups[1])) + 1 if main and groups[1] else 1
        size = 280 + (1 << cache if cache else 0)
        books = []
        for g in range(n):  # other weights, so other codes, for each group
            books.append([webp.code_lengths([1 + (s * (g + 1)) % 5 for s in range(k)]) for k in (size, 256, 256, 256, 40)])
            for b in books[-1]:
                self.pairs(webp.write_lengths(b))
        books = [[(b, webp.codes(b)) for b in book] for book in books]
        sym = lambda g, k, s: self.put(books[g][k][1][s], books[g][k][0][s])
        held, at, backrefs = {}, 0, dict(backrefs)
        while at < len(argb):
            g = groups[1][(at // width) >> groups[0]][(at % width) >> groups[0]] if main and groups[1] else 0
            c = argb[at]
            key = (webp.CACHE_FACTOR * c & 0xFFFFFFFF) >> (32 - cache) if cache else None
            if at in backrefs:
                length, distance = backrefs[at]
                near = [i + 1 for i, (x, y) in enumerate(webp.NEAR) if max(1, x + y * width) == distance]
                s, e, k = webp.prefix(length)
                sym(g, 0, 256 + s)
                self.put(e, k)
                s, e, k = webp.prefix(near[0] if near else distance + 120)
                sym(g, 4, s)
                self.put(e, k)
                step = length
            elif cache and held.get(key) == c:
                sym(g, 0, 280 + key)
                step = 1
            else:
                for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                    sym(g, k, c >> shift & 255)
                step = 1
            for x in argb[at : at + step]:
                if cache:
                    held[(webp.CACHE_FACTOR * x & 0xFFFFFFFF) >> (32 - cache)] = x
            at += step

    def stream(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def start(width, height):
    w = Writer()
    w.pairs([(webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)])
    return w


def flat(px):
    return [int(b) | int(g) << 8 | int(r) << 16 | int(a) << 24 for b, g, r, a in px.reshape(-1, 4)]


def noise(width, height, seed):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 4)).astype(np.uint8)


def test_cache_groups_and_back_references():
    px = noise(13, 11, 1)
    px[4:8] = px[0:4]
    px[8, :] = px[8, 0]
    px[9:, 3] = px[0, 0]
    groups = (2, [[(x + y) % 3 for x in range(4)] for y in range(3)])
    for cache in (0, 1, 5):
        for refs in ({}, {52: (52, 52), 105: (12, 1)}, {52: (30, 52), 82: (22, 52)}):
            w = start(13, 11)
            w.put(0, 1)
            w.image(flat(px), 13, cache, groups, refs)
            assert (webp.decode_vp8l(w.stream()) == px).all()


def predicted(px, y, x, mode):
    """The predictor, one sample at a time, from the specification."""
    at = lambda j, i: px[j, i].astype(int)
    black = np.array([0, 0, 0, 255])
    if y == 0:
        return black if x == 0 else at(0, x - 1)
    if x == 0:
        return at(y - 1, 0)
    left, top, corner = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
    right = at(y - 1, x + 1) if x + 1 < px.shape[1] else at(y, 0)
    avg = lambda a, b: np.array([(int(p) + int(q)) // 2 for p, q in zip(a, b, strict=True)])
    clamp = lambda v: np.array([min(255, max(0, int(c))) for c in v])
    if mode == 11:
        guess = left + top - corner
        return left if abs(guess - left).sum() < abs(guess - top).sum() else top
    if mode == 13:
        m = avg(left, top)
        return clamp([p + int((int(p) - int(q)) / 2) for p, q in zip(m, corner, strict=True)])
    return [black, left, top, right, corner, avg(avg(left, right), top), avg(left, corner), avg(left, top), avg(corner, top), avg(top, right), avg(avg(left, corner), avg(top, right)), None, clamp(left + top - corner)][mode]


def test_predictor_modes():
    px = noise(9, 33, 2)
    px[5:20] //= 4
    modes = [[(3 * y + x) % 14 for x in range(3)] for y in range(9)]
    rest = np.array([[(px[y, x].astype(int) - predicted(px, y, x, modes[y >> 2][x >> 2])) & 255 for x in range(9)] for y in range(33)]).astype(np.uint8)
    w = start(9, 33)
    w.pairs([(1, 1), (0, 2), (0, 3)])
    w.image([m << 8 for row in modes for m in row], 3)
    w.put(0, 1)
    w.image(flat(rest), 9, 0, (2, None))
    assert (webp.decode_vp8l(w.stream()) == px).all()


def test_cross_colour_then_subtract_green():
    px, factors = noise(10, 6, 3), noise(3, 2, 4)
    s8 = lambda v: (int(v) + 128) % 256 - 128
    rest = px.astype(int)
    rest[..., 0] -= rest[..., 1]
    rest[..., 2] -= rest[..., 1]
    rest &= 255
    for y in range(6):
        for x in range(10):
            to_red, to_blue, red_blue, _ = factors[y >> 2, x >> 2]
            b, g, r, _ = rest[y, x]
            rest[y, x, 0] = (b - (s8(to_blue) * s8(g) >> 5) - (s8(red_blue) * s8(r) >> 5)) & 255
            rest[y, x, 2] = (r - (s8(to_red) * s8(g) >> 5)) & 255
    w = start(10, 6)
    w.pairs([(1, 1), (2, 2), (1, 1), (1, 2), (0, 3)])
    w.image(flat(factors), 3)
    w.put(0, 1)
    w.image(flat(rest.astype(np.uint8)), 10, 0, (2, None))
    assert (webp.decode_vp8l(w.stream()) == px).all()


@pytest.mark.parametrize("n", [1, 2, 4, 16, 17, 256])
def test_palettes(n):
    colours = noise(n, 1, n)[0]
    index = np.random.default_rng(n).integers(0, n, (7, 11))
    shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    per, wide = 1 << shift, -(-11 >> shift)
    packed = [[255 << 24 | sum(int(index[y, x]) << ((8 >> shift) * k) for k, x in enumerate(range(v * per, min(11, v * per + per)))) << 8 for v in range(wide)] for y in range(7)]
    w = start(11, 7)
    w.pairs([(1, 1), (3, 2), (n - 1, 8)])
    w.image(flat(np.diff(colours.astype(int), axis=0, prepend=0).astype(np.uint8)), n)
    w.put(0, 1)
    w.image([v for row in packed for v in row], wide, 0, (2, None))
    assert (webp.decode_vp8l(w.stream()) == colours[index]).all()


def payloads():
    rng = np.random.default_rng(5)
    line = "a line that comes again and again, with é\n"
    texts = [None, "", "x", "\0" * 10, line * 400, "z" * 100_000, "".join(map(chr, rng.integers(32, 900, 5000))), " ".join(["word"] * 300_000), "a" * 64, "b" * 63, line * 2 + "\n" * 70]
    return texts


def test_round_trip_of_texts(spark):
    rows = [(i, t, b"m", 0.5) for i, t in enumerate(payloads())]
    df = spark.createDataFrame([*rows, rows[4], (None, None, None, None)], "doc_id long, text string, payload binary, n_bytes double")
    got = media.report(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        data = (payloads()[r.doc_id] if r.doc_id is not None else None) or ""
        data = data.encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(padded), zlib.crc32(padded[-64:]))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        kept = webp.encode(padded)
        assert r.media_bytes == len(kept) and r.media_sha256 == hashlib.sha256(kept).hexdigest() and r.feature
    long = next(r for r in got if r.doc_id == 4)
    assert long.media_bytes < long.n_bytes / 6
    assert media.report(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        media.stored(df, into="payload")
    with pytest.raises(ValueError):
        webp.decode(b"RIFFxxxxWEBPVP8 ")


@pytest.mark.parametrize(("width", "height"), [(1, 1), (1, 7), (2, 9), (9, 1), (17, 5), (3, 20)])
def test_predictor_at_narrow_and_flat_sizes(width, height):
    px, rng = noise(width, height, 40 + width), np.random.default_rng(width)
    modes = rng.integers(0, 14, (-(-height >> 2) + 1, -(-width >> 2) + 1)).astype(np.uint8)
    rest = np.array([[(px[y, x].astype(int) - predicted(px, y, x, modes[y >> 2][x >> 2])) & 255 for x in range(width)] for y in range(height)]).astype(np.uint8)
    assert (webp._undo_predictor(rest, 2, modes) == px).all()


def test_pixel_arrays_have_every_channel(spark):
    px = noise(13, 8, 21)
    w = start(13, 8)
    w.put(0, 1)
    w.image(flat(px), 13, 0, (2, None))
    file = webp._file(w.stream())
    df = spark.createDataFrame([(1, file), (2, file + file), (3, None)], "doc_id long, media binary")
    one, two, none = (media.pixels(df).orderBy("doc_id")).collect()
    assert bytes(one["pixels"]) == px[..., [2, 1, 0, 3]].tobytes() and [tuple(s) for s in one["sizes"]] == [(13, 8)]
    assert bytes(two["pixels"]) == 2 * bytes(one["pixels"]) and len(two["sizes"]) == 2 and none["pixels"] is None
    assert bytes(media.pixels(df, channels="b").orderBy("doc_id").first()["pixels"]) == px[..., 0].tobytes()
    with pytest.raises(ValueError):
        media.pixels(df, channels="x")
