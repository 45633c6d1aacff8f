import numpy as np

from veilframe.llm import ann
from veilframe.llm.queries import QUERIES
from veilframe.llm.shared import table

DATA = "/root/testdata/sf0.1"


def brute(ids, vectors, asked, k):
    out = {}
    for q in asked:
        near = sorted({(-sum(a * b for a, b in zip(vectors[q], vectors[i], strict=True)), i) for i in ids if i != q and len(vectors[i]) == len(vectors[q])})[:k]
        out[q] = [i for _, i in near]
    return out


def test_factor_one_is_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    vectors = {i: [float(x) for x in rng.integers(-3, 4, 6)] for i in range(400)}
    vectors |= {i: [1.0, 2.0, 0.0, 0.0, 3.0, 1.0] for i in range(400, 520)}  # one vector often
    good = {i: v for i, v in vectors.items() if any(v)}
    rows = [(i, v, 1.0, 3) for i, v in vectors.items()]
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, []), (None, [1.0] * 6), (906, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(i, v, 1.0, 3) for i, v in odd] + rows[:3], "vec_id long, embedding array<double>, score double, rank int")
    want = brute([*good], good, [i for i in good if i % 20 == 0], 20)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), factor=1.0, shard=100, block=7, leaf=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    assert {q: list(dict.fromkeys(v)) for q, v in got.items()}.keys() == want.keys()
    for q, near in want.items():
        found = list(dict.fromkeys(got[q]))
        assert found == near[: len(found)] and len(got[q]) == 20
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_recall_and_pruning():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(6000, 32))
    points /= np.linalg.norm(points, axis=1)[:, None]
    exact = np.sort(points[:200] @ points.T, axis=1)[:, ::-1][:, 1:21]
    ids = np.arange(6000)
    for factor, least in ((1.0, 1.0), (ann.FACTOR, 0.9)):
        found = ann.search_shard(ids, points, ids[:200], points[:200], 20, factor)
        scores = found.groupby("query_id").score.apply(np.array)
        recall = np.mean([(scores[i] >= exact[i, -1] - 1e-12).sum() / 20 for i in range(200)])
        assert recall >= least


def lengthened(points, how, rng):
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    if how == "outlier":
        unit[7] *= 5
        return unit
    return unit * rng.lognormal(0, how, len(unit))[:, None]


def test_recall_where_lengths_differ(spark):
    rng = np.random.default_rng(8)
    for how in ("outlier", 0.25, 0.5):
        points, ids = lengthened(rng.normal(size=(6000, 32)), how, rng), np.arange(6000)
        exact = points[:100] @ points.T
        exact[ids[:100], ids[:100]] = -np.inf
        exact = np.sort(exact, axis=1)[:, ::-1][:, :20]
        scores = ann.search_shard(ids, points, ids[:100], points[:100], 20, ann.FACTOR).groupby("query_id").score.apply(np.array)
        assert np.mean([(scores[i] >= exact[i, -1] - 1e-12).sum() / 20 for i in range(100)]) >= 0.99
    df = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    found = ann.nearest(df, df.where("vec_id < 100"), shard=3000).toPandas().sort_values(["query_id", "rank"])
    assert np.allclose(found.score.to_numpy().reshape(100, 20), exact)


def test_registered_query_against_brute_force(spark):
    rows = table(spark, DATA, "embeddings").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, points = rows.vec_id.to_numpy(), np.stack([np.asarray(x, np.float64) for x in rows.embedding])
    asked = np.flatnonzero(ids % 20 == 0)
    exact = points[asked] @ points.T
    exact[np.arange(len(asked)), asked] = -np.inf
    exact = np.sort(exact, axis=1)[:, ::-1][:, :20]
    found = QUERIES["op1_vantage_point_ann"](spark, DATA).toPandas().sort_values(["query_id", "rank"])
    assert found.query_id.to_numpy()[::20].tolist() == ids[asked].tolist()
    assert np.allclose(found.score.to_numpy().reshape(-1, 20), exact)


def plain_best(ids, points, asked, k):
    scores = np.einsum("ik,jk->ij", points[asked], points, optimize=False)
    out = {}
    for row, q in zip(scores, asked, strict=True):
        order = [i for i in np.lexsort((ids, -row)) if i != q][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def test_trees_keep_every_tie():
    rng = np.random.default_rng(11)
    kinds = {"bits": rng.integers(0, 2, (1500, 12)), "signs": rng.integers(-1, 2, (1500, 16)), "plus-minus": rng.choice([-1, 1], (1500, 24))}
    for points in kinds.values():
        points = points[np.abs(points).sum(axis=1) > 0].astype(float)
        ids = rng.permutation(len(points)) * 3
        asked = np.arange(0, len(points), 9)
        got = ann.search_shard(ids, points, ids[asked], points[asked], 20, 1.0, leaf=16)
        assert {q: g.vec_id.tolist() for q, g in got.groupby("query_id", sort=False)} == plain_best(ids, points, asked, 20)


def test_exact_on_clustered_vectors_of_unequal_lengths():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(30, 16))
    points = (centres[rng.integers(0, 30, 5000)] + 0.1 * rng.normal(size=(5000, 16))) * rng.lognormal(0, 0.5, 5000)[:, None]
    points[3] *= 1e3
    ids, asked = np.arange(5000), np.arange(0, 5000, 40)
    got = ann.search_shard(ids, points, ids[asked], points[asked], 20, 1.0, leaf=64)
    want = plain_best(ids, points, asked, 20)
    assert {q: g.vec_id.tolist() for q, g in got.groupby("query_id", sort=False)} == want
    seen = ann.search_shard(ids, points / np.linalg.norm(points, axis=1)[:, None], ids[asked], points[asked], 20, 0.5, leaf=64)
    assert len(seen) == len(got)  # a smaller factor finds as many, if perhaps not the nearest


def test_rows_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 0"), k=20).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2.0), (2, 1.0), (1, 0.0)]
