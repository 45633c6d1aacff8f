import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from veilframe.llm import simhash
from veilframe.llm.components import components
from veilframe.llm.shared import written


def slow_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(items, radius):
    ids, fps = [i for i, _ in items], [f for _, f in items]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return [least[find(k)] for k in range(len(ids))]


def documents():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        out.append((i * 3 + 1, " ".join(base)))
        for k in range(rng.randrange(0, 4)):
            other = list(base)
            other[rng.randrange(len(other))] = "changed"
            out.append((1000 + i * 10 + k, rng.choice([" ", "\n", "\t "]).join(other).upper()))
    return [*out, (500, None), (501, ""), (None, ""), (502, " \n"), (502, " \n"), (503, "ÀB é"), (504, "Àb É"), (None, "lonely text here and there")]


def test_against_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, fp string, root int").repartition(5)
    got = simhash.near_duplicates(df).select("doc_id", simhash.hexadecimal("fp").alias("fp"), "component_id").collect()
    fps = [slow_fingerprint(t, 4) for _, t in docs]
    want = slow_components([(i, f) for (i, _), f in zip(docs, fps, strict=True)], 4)
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.fp, r.component_id) for r in got) == order((i, f"{f:016x}", w) for (i, _), f, w in zip(docs, fps, want, strict=True))
    kept = simhash.representatives(df, 4, 4, None)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(w) for w in want})


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    more = [int(b) ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for b in base for _ in range(4)]
    fps = sorted({*base.tolist(), *more})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = slow_components([(f, f & (2**64 - 1)) for f in fps], 4)
    for tile in (40, simhash.TILE):
        found = simhash.links(df, 4, tile).cache()
        assert found.count() < (tile == simhash.TILE and 1 or 40) * len(fps)
        root = {r.node: r.root for r in components(found).collect()}
        assert [root.get(f, f) for f in fps] == want


def test_long_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(1, 41)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0


def test_similarity_is_checked(spark):
    docs = [(i, t) for i, t in documents() if i is not None]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 14, 0.8).collect()}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in docs for w in [(t or "").encode().lower().split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in sets}


@pytest.mark.parametrize(("tile", "chunk"), [(simhash.TILE, simhash.CHUNK), (30, 6000)])
def test_dense_groups_lose_no_similar_pair(spark, monkeypatch, tile, chunk):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "CHUNK", chunk)  # the group is dealt to pairs of blocks
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    shared, docs = [rng.choice(words) for _ in range(150)], []
    for g in range(40):
        own = [rng.choice(words) for _ in range(rng.choice((10, 30, 60)))]
        for _ in range(4):
            copy = [*shared, *own]
            copy[rng.randrange(len(copy))] = f"new{g}"
            docs.append((len(docs), " ".join(copy)))
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in docs for w in [t.split()]]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(docs)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5, 14, 0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(docs))}
    made = written(simhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), 5, sets=True), "f")
    assert simhash.links(made.drop("doc_id"), simhash.RADIUS, similarity=0.8).count() < (tile == 30 and 12 or 3) * len(docs)  # no pairs of a group, only ways through it
    one, two = simhash.shingle_bins(docs[0][1], 5), simhash.shingle_bins("", 5)
    assert one[0] == len(sets[0]) == sum(one[1]) and two[0] == 1


def test_equal_fingerprints_of_different_texts_do_not_link(spark):
    rng = random.Random(12)
    say = lambda tag, n: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n))
    docs = []
    for g in range(12):
        line = say(f"line{g}x", rng.choice((7, 9, 11, 13)))
        own = [say(f"own{g}x{k}x", 60) for k in range(2)]
        docs += [f"{' '.join([line] * 30)} {x}" for x in own]
        docs.append(f"{' '.join([line] * 2)} {own[0]}")  # the same shingles nearly, repeated less often
    fps = [slow_fingerprint(t, 5) for t in docs]
    assert sum(a == b for a, b in zip(fps[::3], fps[1::3], strict=True)) >= 10
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), 5, 14, 0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - 2 if i % 3 == 2 else i for i in range(len(docs))}


def test_stage_against_plain_jaccard(spark):
    rng = random.Random(21)
    words, docs, far = [f"w{i}" for i in range(2000)], [], 0
    jaccard = lambda a, b: len(a & b) / len(a | b)
    shingles = lambda w: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}
    while far < 12:  # edited copies near the threshold, most of them with fingerprints further apart than 14 bits
        one = [rng.choice(words) for _ in range(rng.randrange(15, 120))]
        two = list(one)
        while jaccard(shingles(one), shingles(two)) >= 0.88:
            two.insert(rng.randrange(len(two)), rng.choice(words))
        apart = bin(slow_fingerprint(" ".join(one), 5) ^ slow_fingerprint(" ".join(two), 5)).count("1") > 14
        if apart and jaccard(shingles(one), shingles(two)) >= 0.8 or rng.random() < 0.02:
            far += apart
            docs += [" ".join(one), " ".join(two)]
    sets = [shingles(t.split()) for t in docs]
    gone = {j for j in range(len(docs)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}
    assert len(gone) >= 12
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, df, "").collect()}
    assert kept == set(range(len(docs))) - gone


def test_similar_pairs_are_counted_exactly():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[rng.permutation(90)[: int(rng.integers(60, 91))]], rng.integers(0, 2**63, int(rng.integers(0, 9)), dtype=np.uint64)))) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert 0 < sum(want) < len(want) and simhash._are_similar(sets, 0.8)(i, j).tolist() == want
    for shift in (0, 60):  # what the histograms rule out is never similar
        hist = [simhash._histogram(x) for x in sets] * 2
        may = simhash._may_be_similar(np.array([n for n, _ in hist]), [b for _, b in hist], 0.8, shift)
        assert all(m or not w for m, w in zip(may(i, j).tolist(), want, strict=True))


def test_histograms_of_long_texts_fold():
    rng = np.random.default_rng(7)
    long = np.unique(rng.integers(0, 2**63, 1100, dtype=np.uint64))
    part = long[:1000]
    assert [len(simhash._histogram(x)[1]) for x in (long, part, long[:100])] == [256, 128, 64]
    sketch = [simhash._histogram(x) for x in (long, part, np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64)))]
    may = simhash._may_be_similar(np.array([n for n, _ in sketch]), [b for _, b in sketch], 0.8)
    assert may(np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]


def test_odd_rows_in_the_pipeline_stage(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None, "x", 3), (2, "", "y", None), (3, long, None, 1), (4, long + " end", "z", 2), (5, "few words", "z", 2), (5, "few words", "z", 2), (None, "few words", "q", 1), (None, "none like it", "q", 1), (None, "none like it", "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, rows int")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect()) == [(0, "none like"), (1, ""), (3, "word0 wor"), (5, "few words")]


def test_short_texts_lose_no_similar_pair(spark):
    """Sets of 4 to 64 shingles whose similarity is at or just above 0.8, many of them further apart than the radius."""
    rng = random.Random(31)
    docs, want, far = [], {}, 0
    for g in range(400):
        n = rng.choice((4, 5, 6, 7, 8, 10, 12, 15, 20, 40, 50, 64))
        words = [f"w{g}x{rng.randrange(10**6)}" for _ in range(n + 4)]
        more = max(1, int(n * 0.25 + 1e-9))  # n of n + more shingles in common
        copy = words + [f"m{g}x{k}" for k in range(more)] if n >= 4 and n / (n + more) >= 0.8 else list(words)
        one, two = ({" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, copy))
        assert len(one & two) >= 0.8 * len(one | two)
        far += bin(slow_fingerprint(" ".join(words), 5) ^ slow_fingerprint(" ".join(copy), 5)).count("1") > 14
        for w in (words, copy):
            want[len(docs)] = 2 * g
            docs.append((len(docs), " ".join(w)))
    assert far > 10
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for radius in (simhash.RADIUS, 0):  # also without any help of the fingerprints
        got = simhash.near_duplicates(df, 5, radius, 0.8).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_rare_shingles_tie_similar_sets_only_by_stars(spark):
    rng = random.Random(32)
    common = [rng.randrange(2**62) for _ in range(60)]
    rows = [(k, 70, common + [rng.randrange(2**62) for _ in range(10)]) for k in range(300)]  # a passage in all: ties at most by stars
    rows += [(1000 + k, 10, [10**18 + k * 10 + j for j in range(10)]) for k in range(50)]  # alone
    classes = spark.createDataFrame(rows, "key long, n long, few array<long>")
    found = simhash.rare_links(classes, 0.8).collect()
    assert all(r.a < r.b < 1000 for r in found) and len(found) <= 15 * 300
    assert simhash.rare_links(classes.limit(0), 0.8).count() == 0


def test_a_second_fingerprint_errs_on_its_own():
    rng = np.random.default_rng(4)
    apart = []
    for _ in range(2000):
        both = rng.integers(0, 2**64, 125, dtype=np.uint64)
        one, two = both[:125], np.concatenate((both[:100], rng.integers(0, 2**64, 0, dtype=np.uint64)))
        apart.append([bin((simhash._majority(f(one)) ^ simhash._majority(f(two))) & (2**64 - 1)).count("1") for f in (lambda x: x, simhash._other)])
    apart = np.array(apart)
    assert abs(np.corrcoef(apart.T)[0, 1]) < 0.1 and not (apart.min(axis=1) > simhash.RADIUS).any()
