"""SimHash fingerprints and their near-duplicates, by an exact tiled comparison.

Distinct fingerprints are dealt into tiles by their population count: small neighbouring counts share a
tile, and a count with many rows is cut into several by hash. Two fingerprints within ``radius``
differing bits have counts that differ by ``radius`` at most, so only such pairs of tiles meet, each
in a task of its own. Inside a task the rows are ordered by the counts of their quarters, cut into
blocks, and blocks whose ranges of counts lie further apart than the radius are skipped again; the
rest are compared completely with numpy's exclusive-or and bit counts. A task returns a spanning
forest of the links it found: no link between different components is lost and no group is expanded
into all its pairs. Rounds of joins then find the components.

Where links count only if the texts' shingles are similar enough (Jaccard), texts with the same set of
shingles are one class, two independent fingerprints are taken of that set (a pair is a candidate within the radius
of either), and each carries the set's size and a histogram of it. Sets of up to ``FEW`` shingles, whose fingerprints
scatter most, are also candidates by an exact rule: of two similar sets each has one of its rarest shingles, as many as
the similarity lets it miss and one more, in common with the other's. Similar sets have similar sizes, so tiles are also cut by bands of the size, and only a band and the
next one meet. Two texts' histograms differ by no more than their sets do, so a larger difference than
the similarity allows rules a pair out inside the tile, and never a link. What the forests of this first
comparison leave in different components can't be similar. A second comparison takes one component at a
time, the small ones several to a task and a large one in pairs of blocks, with the whole texts: pairs that
are not in one class yet are tested by counting their common shingles, whatever their fingerprints, and again a spanning forest is
returned. So a group makes as many links as it has rows, whether its texts are similar or only nearly so.

Words are the runs of `[^\\x20\\x09-\\x0D]` after A-Z is lower-cased; shingles are ``width`` words
joined by spaces, repeats counted; with fewer words the whole sequence is the one shingle; without
words (null, empty or blank texts) the fingerprint is zero, linked like any other. Repeated rows and
repeated ids are rows like others; a null id never becomes a component's id unless all of its
component's ids are null. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.components import components
from veilframe.llm.shared import discard, written

SEED = 42
#: Rows of one tile (half as many with histograms), and bytes of its histograms: some MB for a task whatever the input.
#: Larger tiles send each row to fewer tasks, which take longer.
TILE, TILE_BYTES = 65_536, 16 << 20
#: Rows of one block inside a tile, and pairs looked at in one step.
BLOCK, PAIRS = 256, 1 << 16
#: Differing bits, of one of two fingerprints, up to which texts are candidates for a Jaccard similarity of 0.8: some 10
#: bits are usual there, and one pair in some 20,000 of that very similarity differs in more of one fingerprint.
RADIUS = 22
#: Sets up to this size are candidates by their rarest shingles as well. Similar sets of which one has 64 or fewer are both among them.
FEW = 80
#: Least and largest number of bins of the histogram of a text's shingles, one saturating byte each; one bin for 8 shingles.
BINS, MOST_BINS, PER_BIN = 64, 1 << 16, 8
#: Shingles of one block of texts in the second comparison (each text counts 64 more), and elements counted in one step.
CHUNK, STEP = 1 << 18, 1 << 20
#: Rows up to which a table of ids (some 50 bytes a row) is broadcast to the texts; beyond it the texts are shuffled to the ids.
BROADCAST_ROWS = 500_000


def _hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; a text without words has one, of nothing."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z changes, only ASCII white space separates
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    return np.array([digest(line[i:j], SEED) for i, j in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed integer; 0 for the one hash of nothing."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def text_fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of one text, as a signed integer."""
    return _majority(_hashes(text, width)) if text and text.encode().split() else 0


def shingle_bins(text: str | None, width: int) -> tuple[int, bytes]:
    """Number of different shingles of a text, and their histogram by hash, of more bins for more shingles."""
    return _histogram(np.unique(_hashes(text, width)))


def _histogram(hashes: np.ndarray) -> tuple[int, bytes]:
    bins = min(MOST_BINS, max(BINS, 1 << (len(hashes) // PER_BIN - 1).bit_length()))
    counts = np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return len(hashes), np.minimum(counts, 255).astype(np.uint8).tobytes()


def _set_key(hashes: np.ndarray) -> int:
    """A digest of a set of shingles, as a signed integer."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED + 1) - (1 << 63)


def _other(hashes: np.ndarray) -> np.ndarray:
    """The hashes mixed (multiplications and shifts), for a second fingerprint that errs independently of the first."""
    out = hashes.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def set_sketch(text: str | None, width: int) -> tuple[int, int, int, int, bytes, list[int] | None]:
    """Of a text's different shingles: two SimHashes, digest, number, histogram, and themselves if they are few."""
    hashes = np.unique(_hashes(text, width))
    fps = (_majority(hashes), _majority(_other(hashes))) if text and text.encode().split() else (0, 0)
    return (*fps, _set_key(hashes), *_histogram(hashes), hashes.view(np.int64).tolist() if len(hashes) <= FEW else None)


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text", sets: bool = False) -> DataFrame:
    """(doc_id, digest, fp): a digest of the text and its signed 64-bit fingerprint for every row; with ``sets`` what ``set_sketch`` returns, as fp, fp2, key, n, bins and few."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if sets:
                made = [set_sketch(x, width) for x in texts]
                kinds = {"fp": pa.int64(), "fp2": pa.int64(), "key": pa.int64(), "n": pa.int64(), "bins": pa.binary(), "few": pa.list_(pa.int64())}
                columns = {c: pa.array([m[k] for m in made], kind) for k, (c, kind) in enumerate(kinds.items())}
            else:
                columns = {"fp": pa.array([text_fingerprint(x, width) for x in texts], pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "digest": batch.column(2), **columns})

    return rows.mapInArrow(run, "doc_id long, digest long, fp long" + ", fp2 long, key long, n long, bins binary, few array<long>" * sets)


class _Forest:
    """Union by labels: few Python steps, as only links between different labels reach it."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Takes those of the links (i, j) that tie components, earlier ones first."""
        a, b = self.label[i], self.label[j]
        differ = np.flatnonzero(a != b)
        if not len(differ):
            return
        a, b = a[differ], b[differ]
        key, first = np.unique(np.minimum(a, b).astype(np.int64) * len(self.label) + np.maximum(a, b), return_index=True)
        order = np.argsort(first)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for k, at in zip(key[order].tolist(), differ[first[order]].tolist(), strict=True):
            x, y = find(k // len(self.label)), find(k % len(self.label))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.links.append((int(i[at]), int(j[at])))
        if parent:
            to = np.arange(len(self.label))
            for x in parent:
                to[x] = find(x)
            self.label = to[self.label]


def _blocks(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by the counts of the four quarters; per block, the least and largest count of each quarter."""
    quarters = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(quarters.T[::-1])
    quarters = quarters[order]
    starts = np.arange(0, len(fps), BLOCK)
    return order, starts, np.minimum.reduceat(quarters, starts), np.maximum.reduceat(quarters, starts)


Pairs = Callable[[np.ndarray, np.ndarray], np.ndarray]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, may: Pairs | None = None, does: Pairs | None = None) -> np.ndarray:
    """A spanning forest of the links within ``left``, or between it and ``right``: an array of pairs of positions.

    Of the pairs within ``radius`` those count for which ``may`` (a quick test of arrays of positions) and ``does`` (a
    dear one) hold. Only pairs that earlier links have not put into one component are tested.
    """
    own = right is None
    order, starts, least, most = _blocks(left)
    order2, starts2, least2, most2 = (order, starts, least, most) if own else _blocks(right)
    x, y = left[order], (left if own else right)[order2]
    shift = 0 if own else len(x)
    forest = _Forest(len(x) + (0 if own else len(y)))
    for k, start in enumerate(starts.tolist()):
        gap = np.maximum(least2 - most[k], least[k] - most2)
        near = np.flatnonzero(np.maximum(gap, 0).sum(axis=1) <= radius)
        if own:
            near = near[near >= k]
        a = x[start : start + BLOCK]
        for other in np.array_split(near, max(1, -(-len(near) // 16))):
            if not len(other):
                continue
            places = np.concatenate([np.arange(s, min(s + BLOCK, len(y))) for s in starts2[other].tolist()])
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ y[places][None, :]) <= radius)
            i, j = i + start, places[j]
            apart = forest.label[i] != forest.label[j + shift]
            if own:
                apart &= i < j
            i, j = i[apart], j[apart]
            if may is not None:
                i, j = i[(good := may(order[i], order2[j]))], j[good]
            if does is not None:
                # one way between each two components first, as most others needn't be tested after it
                first = np.unique(forest.label[i].astype(np.int64) * len(forest.label) + forest.label[j + shift], return_index=True)[1]
                for some in (first, np.setdiff1d(np.arange(len(i)), first, assume_unique=True)):
                    p, q = i[some], j[some]
                    p, q = p[(apart := forest.label[p] != forest.label[q + shift])], q[apart]
                    good = does(order[p], order2[q])
                    forest.add(p[good], q[good] + shift)
            else:
                forest.add(i, j + shift)
    both = order if own else np.concatenate((order, order2 + len(x)))
    return both[np.array(forest.links, dtype=np.int64).reshape(-1, 2)]


def _may_be_similar(n: np.ndarray, bins: list[bytes], similarity: float, shift: int = 0) -> Pairs:
    """Whether pairs of positions (the second counted from ``shift``) can reach ``similarity``: sets of sizes n and m that
    do differ in no more than (n + m)(1 - similarity) / (1 + similarity) elements, and their histograms in no more than that."""
    width = min(map(len, bins), default=BINS)
    folded = [x if x.size == width else np.minimum(x.reshape(-1, width).sum(axis=0, dtype=np.int64), 255).astype(np.uint8) for x in (np.frombuffer(b, np.uint8) for b in bins)]
    h = np.stack(folded) if folded else np.zeros((0, width), np.uint8)
    piece = max(1, PAIRS * BINS // width)

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        j = j + shift
        limit = (n[i] + n[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        found = np.abs(n[i] - n[j]) <= limit
        i, j, limit = i[found], j[found], limit[found]
        apart = []
        for k in range(0, len(i), piece):
            one, two = h[i[k : k + piece]], h[j[k : k + piece]]
            apart.append((np.maximum(one, two) - np.minimum(one, two)).sum(axis=1, dtype=np.int64))
        found[found] = (np.concatenate(apart) if apart else np.zeros(0)) <= limit
        return found

    return may


def _are_similar(sets: list[np.ndarray], similarity: float, shift: int = 0) -> Pairs:
    """Whether pairs of positions share ``similarity`` or more of their different shingles, by counting the common ones."""
    n = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(n)
    names, flat = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    seen = np.zeros(len(names), bool)

    def does(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, j = np.zeros(len(i), bool), j + shift
        order = np.argsort(i, kind="stable")
        cuts = np.flatnonzero(np.diff(i[order])) + 1
        for run in np.split(order, cuts) if len(order) else ():
            one = i[run[0]]
            seen[flat[ends[one] - n[one] : ends[one]]] = True
            pieces = np.flatnonzero(np.diff(np.cumsum(n[j[run]]) // STEP)) + 1
            for piece in np.split(run, pieces):
                two = j[piece]
                upto = np.cumsum(n[two])
                places = np.arange(upto[-1]) + np.repeat(ends[two] - upto, n[two])
                common = np.add.reduceat(seen[flat[places]], upto - n[two], dtype=np.int64)
                out[piece] = common >= similarity * (n[one] + n[two] - common)
            seen[flat[ends[one] - n[one] : ends[one]]] = False
        return out

    return does


def _small(df: DataFrame) -> DataFrame:
    """``df``, of a written table, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _named(found: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": names[found[:, 0]], "b": names[found[:, 1]]})


def _task(radius: int, similarity: float | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = bool(pdf["own"].iloc[0])
        both = pdf if own else pd.concat([pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]])
        shift = 0 if own else int((pdf["side"] == 0).sum())
        fps = both["fp"].to_numpy(np.int64).view(np.uint64)
        may = None if similarity is None else _may_be_similar(both["n"].to_numpy(np.int64), both["bins"].tolist(), similarity, shift)
        found = tile_links(fps, None, radius, may) if own else tile_links(fps[:shift], fps[shift:], radius, may)
        return _named(found, both["key"].to_numpy(np.int64))

    return run


def _tiled(rows: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their tile, and (band, tile, low, high): the counts in each tile. ``rows`` have band, fp and width."""
    levels = rows.withColumn("level", F.bit_count("fp").cast("long"))
    sizes = levels.groupBy("band", "level").agg(F.count(F.lit(1)).alias("c"), F.max("width").alias("w"))  # 65 rows a band at most
    band = Window.partitionBy("band")
    room = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_BYTES) / F.max("w").over(band))))
    ahead = F.coalesce(F.sum("c").over(band.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = sizes.select("band", "level", "c", room.alias("room"), ahead.alias("ahead")).select("band", "level", F.ceil(F.col("c") / F.col("room")).cast("long").alias("parts"), F.floor(F.col("ahead") / F.col("room")).alias("run"))
    laid = written(laid, "levels")
    number = lambda part: F.when(F.col("parts") > 1, F.concat_ws("-", "level", part.cast("string"))).otherwise(F.concat(F.lit("r"), F.col("run").cast("string")))
    dealt = levels.join(F.broadcast(laid), ["band", "level"]).withColumn("tile", number(F.pmod(F.xxhash64("key"), F.col("parts"))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tiles = laid.select("*", every.alias("part")).select("band", "level", number(F.col("part")).alias("tile")).groupBy("band", "tile").agg(F.min("level").alias("low"), F.max("level").alias("high"))
    return dealt, written(tiles, "tiles")


def links(distinct: DataFrame, radius: int = 4, tile: int | None = None, similarity: float | None = None) -> DataFrame:
    """(a, b): links between the keys of ``distinct`` (key, fp; fp is the key where there is none) at ``radius`` or fewer differing bits, as many as tie what all such links tie.

    ``similarity``: ``distinct`` has n and bins too, and pairs that these rule out don't count.
    """
    if "key" not in distinct.columns:
        distinct = distinct.withColumn("key", F.col("fp"))
    if similarity is None:
        rows, columns, step = distinct.select("key", "fp", F.lit(0).alias("band"), F.lit(8).alias("width")), ["key", "fp"], 0
    else:
        band = F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1.0001 / similarity))).cast("int")  # similar sets are in one band or in neighbours
        rows, columns, step = distinct.select("key", "fp", "n", "bins", band.alias("band"), F.length("bins").alias("width")), ["key", "fp", "n", "bins"], 1
    dealt, tiles = _tiled(rows, tile or (TILE if similarity is None else TILE // 2))
    one = tiles.select(F.col("band").alias("band1"), F.col("tile").alias("tile1"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.explode(F.sequence(F.col("band"), F.col("band") + step)).alias("band2"))
    two = tiles.select(F.col("band").alias("band2"), F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    met = one.join(two, "band2").where((F.col("low2") - F.col("high1") <= radius) & (F.col("low1") - F.col("high2") <= radius))
    same = F.col("band1") == F.col("band2")
    met = met.where(~same | (F.col("tile1") <= F.col("tile2")))
    own = same & (F.col("tile1") == F.col("tile2"))
    task = ["band1", "tile1", "band2", "tile2"]
    first = met.select(*task, own.alias("own"), F.lit(0).alias("side"), F.col("band1").alias("band"), F.col("tile1").alias("tile"))
    second = met.where(~own).select(*task, F.lit(False).alias("own"), F.lit(1).alias("side"), F.col("band2").alias("band"), F.col("tile2").alias("tile"))
    sent = dealt.select("band", "tile", *columns).join(first.union(second), ["band", "tile"])
    return sent.select(*task, "own", "side", *columns).groupBy(*task).applyInPandas(_task(radius, similarity), "a long, b long")


def rare_links(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that tie every two similar sets among those of ``classes`` (key, n, few) that have their shingles listed.

    A set of n shingles that is similar to another misses n - ceil(similarity n) of the other's at most, so of its rarest
    that many and one more (rarest among these sets, ties by hash), one is among the other's rarest too. Shingles of one set
    alone take places and tie nothing. The sets that name a shingle are tied to the least of them, so a shingle makes no pairs.
    """
    rows = classes.where("few is not null").select("key", "n", F.explode("few").alias("h"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = rows.join(shared, "h").groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))  # FEW at most
    places = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.size("x"))).cast("int")
    named = own.where(places > 0).select("key", F.explode(F.slice("x", F.lit(1), places)).alias("s")).select("key", F.col("s.h").alias("h"))
    least = named.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("most")).where("a < most")
    return named.join(least.select("h", "a"), "h").where("a <> key").select("a", F.col("key").alias("b"))


def _exact(width: int, similarity: float):
    radius = 64  # any two fingerprints: candidates by rare shingles may differ in more bits than others

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side", kind="stable")
        sets = [np.unique(_hashes(x, width)) for x in pdf["text"]]
        good = [k for k, (x, key) in enumerate(zip(sets, pdf["key"].tolist(), strict=True)) if _set_key(x) == key]  # ids may repeat: only the key's own text
        good = np.array(good, np.int64)[np.sort(np.unique(pdf["key"].to_numpy(np.int64)[good], return_index=True)[1])] if good else np.zeros(0, np.int64)
        rows, sets = pdf.iloc[good], [sets[k] for k in good]
        own, shift = bool(pdf["own"].iloc[0]), int((rows["side"] == 0).sum())
        shift = 0 if own else shift
        sketch = [_histogram(x) for x in sets]
        may = _may_be_similar(np.array([n for n, _ in sketch], np.int64), [b for _, b in sketch], similarity, shift)
        fps, does = rows["fp"].to_numpy(np.int64).view(np.uint64), _are_similar(sets, similarity, shift)
        found = tile_links(fps, None, radius, may, does) if own else tile_links(fps[:shift], fps[shift:], radius, may, does)
        return _named(found, rows["key"].to_numpy(np.int64))

    return run


def similar_links(near: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): links between classes whose texts are similar, as many as tie what all such links tie.

    ``near`` (node, root) are components outside which no pair is similar. A key's text is that of its smallest id; all
    its texts have the same shingles. Only the texts of classes in ``near`` are read again.
    """
    members = near.union(near.select(F.col("root").alias("node"), "root").distinct())
    members = written(members.join(classes, F.col("node") == F.col("key")).select("root", "key", "fp", "least_id", (F.col("n") + 64).alias("weight")), "members")
    totals = written(members.groupBy("root").agg(F.sum("weight").alias("total")), "groups")
    small = totals.where(F.col("total") <= CHUNK).agg(F.sum("total")).first()[0] or 0
    parts = F.ceil(F.col("total") / CHUNK).cast("long")
    home = F.when(F.col("parts") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(max(1, -(-small // CHUNK)))))
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    dealt = members.join(totals, "root").withColumn("parts", parts).select("key", "fp", "least_id", (F.col("parts") > 1).alias("large"), home.alias("home"), part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    asked = written(dealt.select("key", "fp", "least_id", "large", "home", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), (F.col("part") > F.col("other")).cast("int").alias("side"), (F.col("part") == F.col("other")).alias("own")), "asked")
    rows = docs.join(_small(asked), F.col("doc_id").eqNullSafe(F.col("least_id")))
    return rows.select("large", "home", "one", "two", "side", "own", "key", "fp", "text").groupBy("large", "home", "one", "two").applyInPandas(_exact(width, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, similarity: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, digest): one row per row of ``docs``; component_id is the smallest doc_id reachable over links.

    ``similarity``: fingerprints are of the different shingles, candidates are those within ``radius`` of either fingerprint or
    with rare shingles in common, and links count only if the texts are that similar, also where fingerprints are equal. Texts with the same set of shingles are one class, by its 64-bit digest.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tested = similarity is not None
    marked = written(fingerprints(docs, width, sets=tested), "fingerprints")
    if not tested:
        marked = marked.withColumn("key", F.col("fp"))
    own = [F.first(c).alias(c) for c in (("fp", "fp2", "n", "bins", "few") if tested else ("fp",))]  # the same in all of a class
    classes = written(marked.groupBy("key").agg(F.min("doc_id").alias("least_id"), *own), "classes")
    if not tested:
        roots = components(links(classes, radius))
    else:
        sets = classes.select("key", "fp", "fp2", "n", "bins")
        by_bits = [links(sets.select("key", F.col(fp).alias("fp"), "n", "bins"), radius, similarity=similarity) for fp in ("fp", "fp2")]
        near = components(by_bits[0].union(by_bits[1]).union(rare_links(classes.select("key", "n", "few"), similarity)))
        roots = components(similar_links(near, classes.select("key", "fp", "n", "least_id"), docs, width, similarity))
        discard(near)
    placed = classes.select("key", "least_id").join(roots, F.col("key") == F.col("node"), "left").select("key", "least_id", F.coalesce("root", "key").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "root").select("key", "component_id")
    return marked.select("doc_id", "fp", "key", "digest").join(named, "key").select("doc_id", "fp", "component_id", "digest")


def hexadecimal(fp) -> F.Column:
    """16 lower-case hexadecimal digits of a signed 64-bit fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def representatives(docs: DataFrame, width: int = 5, radius: int = RADIUS, similarity: float | None = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each component, the one with the smallest doc_id.

    Of rows that share this id one stays. Rows without an id stay only if no row of their component
    has one, and then one of them does.
    """
    found = near_duplicates(docs, width, radius, similarity)
    stays = F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("digest"))
    per_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(stays).alias("_digest"))
    stay = written(per_id.where("_digest is not null").select(F.col("doc_id").alias("_kept"), "rows", "_digest"), "stay")
    known = F.col("doc_id").eqNullSafe(F.col("_kept"))
    once = docs.join(_small(stay.where("rows = 1").select("_kept")), known, "left_semi")
    often = stay.where("rows > 1").select("_kept", "_digest")
    if not often.limit(1).count():
        return once
    return once.union(docs.join(often, known & (F.xxhash64("text") == F.col("_digest")), "left_semi").dropDuplicates(["doc_id"]))
