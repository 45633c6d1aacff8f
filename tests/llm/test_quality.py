import zlib

import numpy as np
import pytest

from veilframe.llm import quality
from veilframe.llm.shared import table

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.judged(docs, labels).cache()
    assert got.count() == docs.count()
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    tested = got.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in tested]) >= 0.95
    assert any(r.quality == 0 for r in tested)


def test_prior_and_negative_labels_unused(spark):
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, (4000, 3)), rng.normal(-2, 1, (1000, 3))
    model = quality.fit(good[:2000], np.concatenate((good[2000:], bad)))
    assert model.prior == pytest.approx(2 / 3, abs=0.06)
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    only = quality.train(docs, labels.where("quality = 1"), 300)
    assert np.allclose(only.layers[0], quality.train(docs, labels, 300).layers[0])


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "a word", None), (4, "x" * 300000, 0.0), (4, "x" * 300000, 0.0)], "doc_id long, text string, predicted double")
    labels = spark.createDataFrame([(1, 1), (4, None), (99, 1), (None, 1), (2, 1)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == 5 and all(r.score is not None and r.held_out is not None for r in got)
    assert {r.score for r in quality.judged(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_descent_follows_the_risk_and_undoes_its_negative_part():
    rng = np.random.default_rng(4)
    layers = [rng.normal(0, 1, (3, 4)), rng.normal(0, 1, 4), rng.normal(0, 1, 4), rng.normal(0, 1, 1)]
    a, b = rng.normal(0.5, 1, (30, 3)), rng.normal(0, 1, (40, 3))

    def plain(prior):  # row by row, from the definition; the negative part by itself
        def f(x):
            return sum(v * np.tanh(sum(x[i] * layers[0][i][j] for i in range(3)) + layers[1][j]) for j, v in enumerate(layers[2])) + layers[3][0]

        loss = lambda x, y: 1 / (1 + np.exp(y * f(x)))
        return prior * np.mean([loss(x, 1) for x in a]), np.mean([loss(x, -1) for x in b]) - prior * np.mean([loss(x, -1) for x in a])

    for prior, falls in ((0.1, False), (0.99, True)):
        if falls:
            layers[3][0] = 3.0
            a = a + 1.5 * np.sign(layers[0] @ layers[2])
        kept, negative = plain(prior)
        assert (negative < 0) == falls
        assert quality.risk(layers, a, b, prior) == pytest.approx(kept + max(0, negative))
        got, step = quality.descent(layers, a, b, prior), 1e-6
        for part, grads in zip(layers, got, strict=True):
            for at in np.ndindex(part.shape):
                part[at] += step
                up = plain(prior)
                part[at] -= 2 * step
                down = plain(prior)
                part[at] += step
                want = (sum(up) - sum(down)) / 2 / step if not falls else -(up[1] - down[1]) / 2 / step
                assert grads[at] == pytest.approx(want, abs=1e-6)


def test_moments_and_counts_cover_all_rows(spark):
    docs, labels = table(spark, DATA, "documents").limit(3000).cache(), table(spark, DATA, "labels")
    x = np.stack([quality.shape(r["text"]).astype(np.float32) for r in docs.collect()]).astype(float)
    made = quality.shapes(docs).cache()
    mean, scale = quality.moments(made)
    assert np.allclose(mean, x.mean(axis=0), atol=1e-4) and np.allclose(scale, x.std(axis=0) + 1e-3, atol=1e-3)
    again = quality.moments(made.repartition(13))
    assert (mean == again[0]).all() and (scale == again[1]).all()
    model = quality.train(docs, labels, 200)
    cuts = np.array([0.0, 0.2, 0.5, 0.9, 1.1])
    higher, rows = quality.counted_above(made, model, cuts)
    assert rows == 3000 and list(higher) == [(np.round(model.score(x), 6) >= c).sum() for c in cuts]


def test_one_row_of_very_many_copies_is_one_row_of_the_sample(spark):
    docs = spark.range(20000).selectExpr("if(id < 15000, null, id) as doc_id", "if(id < 15000, 'again', concat('text ', repeat('a', int(id % 50)))) as text")
    rows = quality.collected(quality.shapes(docs))
    assert len(rows.x) == 51 and rows.n.max() == 15000 and rows.n.sum() == 20000
    drawn = rows.draw(np.random.default_rng(2), 4000)
    assert (drawn == rows.x[rows.n.argmax()]).all(axis=1).mean() == pytest.approx(0.75, abs=0.03)
    assert len(quality.collected(quality._sampled(quality.shapes(docs.where("id >= 15000")), 1000)).x) <= 51


def test_the_risk_covers_all_unlabelled_rows(spark):
    rng = np.random.default_rng(8)
    x = np.abs(rng.normal(0.5, 0.3, (5000, quality.WIDTH))).astype(np.float32)
    positive = quality.Rows(x[:300].astype(np.float64), np.ones(300, np.int64))
    layers = [w + rng.normal(0, 0.1, w.shape) for w in quality._start(rng, quality.WIDTH)]
    model = quality.Model(x.mean(axis=0), x.std(axis=0), layers, 0.4)
    rows = spark.createDataFrame([(k, x[k].tobytes()) for k in range(5000)], "doc_id long, x binary")
    loss, grads = quality.summed_gradient(rows.repartition(7), model)
    again = quality.summed_gradient(rows.repartition(2), model)
    assert loss == again[0] and all((a == b).all() for a, b in zip(grads, again[1], strict=True))  # however the rows are dealt
    z = np.clip((x.astype(np.float64) - model.mean) / model.scale, -8, 8)
    s = quality._sigmoid(quality._forward(layers, z)[1])
    assert loss == pytest.approx(s.mean(), abs=1e-4)
    for a, b in zip(grads, quality._gradient(layers, z, s * (1 - s) / len(z)), strict=True):
        assert np.allclose(a, b, atol=2e-4)

    seen = []

    def loss_of(m):
        seen.append(quality.risk(m.layers, np.clip((positive.x - m.mean) / m.scale, -8, 8), z, m.prior))
        return quality.summed_gradient(rows, m)

    best = quality.refined(model, positive, loss_of, passes=12)
    at = quality.risk(best.layers, np.clip((positive.x - best.mean) / best.scale, -8, 8), z, best.prior)
    assert at == pytest.approx(min(seen), abs=1e-3) and at < seen[0] and len(seen) == 13
