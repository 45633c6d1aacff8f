"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled 1; everything else, labelled or not, is unlabelled web
text. The share of positives in it (the class prior) is estimated first: a classifier ranks
positives against unlabelled texts, and the prior is the least ratio, over rank thresholds, of the
unlabelled share above the threshold to the positives' share there. A small network then minimises
the non-negative unbiased risk with that prior (sigmoid loss): first by steps on rows drawn from two samples, then by
passes over all unlabelled rows, each a Spark job that sums their part of the risk and its gradient in the tasks. Of
all weights seen, those of the least risk over all rows are kept. Labels of 0 are never used.

Only shape counts: byte classes, word and line statistics of the whole text, no id, source or
language. The shapes of all rows outside the held-out fold are written once, 80 bytes a row. Means,
scales and the class prior are counted over all of them; only the rows that the gradient steps draw
come from two samples bounded by ``sample`` rows each, chosen by a hash of id and shape, so that the
driver's part costs the same at any scale. Counts are whole numbers, so partitioning changes
nothing. Every document is scored in the tasks that read it, without a shuffle.

Null and empty texts are scored like any text without characters. Repeated rows get equal scores.
Without trusted positives, or without documents, every score is 0. A null doc_id is never held
out. Labels without a document, and null labels, are ignored. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import discard, written

#: Rows of either training sample, at most on average; hidden units, steps and rows of a step.
SAMPLE, HIDDEN, STEPS, BATCH = 20_000, 12, 1_500, 1_024
#: Passes over all unlabelled rows, and their rate.
PASSES, PASS_RATE = 16, 0.003
ACCEPT = 0.7
#: No feature is above this; steps of a unit in which features are summed up.
HIGHEST, UNIT = 16.0, 1 << 16
#: Units of standardised features, and of what is multiplied with them: sums of a batch's products stay below 2 ** 53.
FINE, FINER = float(1 << 10), float(1 << 20)

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".", b",", b"!?", b";:'\"()-", b"|<>=_/\\{}[]", b"%$&*#@^~+`", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _MEMBER[list(_c), _i] = 1


def shape(text: str | None) -> np.ndarray:
    """The features of one whole text."""
    data = (text or "").encode()
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts @ _MEMBER / n
    words, lines = data.split(), data.split(b"\n")
    k = max(1, len(words))
    long = [x for x in lines if len(x) > 10]
    extra = (
        np.log1p(len(data)) / 10,
        len(data) / k / 10,
        len(set(words)) / k,
        len(set(long)) / max(1, len(long)),
        np.log1p(len(data) / len(lines)) / 10,
        counts.max() / n,
        share[1] / (share[0] + share[1] + 1e-9),
    )
    return np.minimum(np.concatenate((np.sqrt(share), extra)), HIGHEST)


WIDTH = len(_CLASSES) + 7


@dataclass
class Model:
    """A standardised network of one hidden layer, and the class prior it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, z)[1], -30, 30)))


def _forward(layers: list[np.ndarray], z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b, v, c = layers
    hidden = np.tanh(z @ w + b)
    return hidden, hidden @ v + c[0]


def _gradient(layers: list[np.ndarray], z: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    hidden, _ = _forward(layers, z)
    back = d[:, None] * layers[2][None, :] * (1 - hidden**2)
    return [z.T @ back, back.sum(axis=0), hidden.T @ d, np.array([d.sum()])]


class _Adam:
    def __init__(self, layers: list[np.ndarray], rate: float = 0.01):
        self.layers, self.rate, self.t = layers, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(self.layers, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g**2 - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _start(rng: np.random.Generator, width: int) -> list[np.ndarray]:
    return [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Different shapes and how often each occurs."""

    x: np.ndarray
    n: np.ndarray

    def draw(self, rng: np.random.Generator, size: int) -> np.ndarray:
        ends = np.cumsum(self.n)
        return self.x[np.searchsorted(ends, rng.integers(ends[-1], size=size), side="right")]


def _rows(x: np.ndarray | Rows) -> Rows:
    return x if isinstance(x, Rows) else Rows(x, np.ones(len(x), np.int64))


def above(scores: np.ndarray, n: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many rows have a score of each cut or more; ``n`` counts the rows of a score."""
    order = np.argsort(scores, kind="stable")
    ends = np.concatenate(([0], np.cumsum(n[order])))
    return ends[-1] - ends[np.searchsorted(scores[order], cuts, side="left")]


def cuts_between(scores: np.ndarray, n: np.ndarray, least_share: float = 0.05, how_many: int = 60) -> np.ndarray:
    """Scores that stand at even shares of the rows, without the outermost ``least_share``."""
    order = np.argsort(scores, kind="stable")
    ends = np.cumsum(n[order])
    return scores[order][np.searchsorted(ends, np.linspace(least_share, 1 - least_share, how_many) * ends[-1])]


def class_prior(positive: np.ndarray, positives: int, unlabelled: np.ndarray, rows: int) -> float:
    """The share of positives in unlabelled rows, from the numbers of either at or above each cut."""
    slack = (np.log(200) / 2 / max(1, rows)) ** 0.5 + (np.log(200) / 2 / max(1, positives)) ** 0.5
    p, u = positive / positives, unlabelled / rows
    return float(np.clip((u / p)[np.argmin((u + slack) / p)], 0.01, 0.99))


def risk(layers: list[np.ndarray], a: np.ndarray, b: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of positives ``a`` and unlabelled rows ``b`` under the sigmoid loss."""
    sa, sb = _sigmoid(_forward(layers, a)[1]), _sigmoid(_forward(layers, b)[1])
    return float(prior * (1 - sa).mean() + max(0.0, sb.mean() - prior * sa.mean()))


def descent(layers: list[np.ndarray], a: np.ndarray, b: np.ndarray, prior: float) -> list[np.ndarray]:
    """The gradient of the risk; where its negative part would fall below zero, the one that undoes that part."""
    sa, sb = _sigmoid(_forward(layers, a)[1]), _sigmoid(_forward(layers, b)[1])
    # losses: sigmoid(-f) for +, sigmoid(f) for -; both have the slope s(1-s) in f, with opposite signs
    slope_a, slope_b = sa * (1 - sa) / len(a), sb * (1 - sb) / len(b)
    if sb.mean() - prior * sa.mean() >= 0:
        ga, gb = _gradient(layers, a, -2 * prior * slope_a), _gradient(layers, b, slope_b)
    else:
        ga, gb = _gradient(layers, a, prior * slope_a), _gradient(layers, b, -slope_b)
    return [x + y for x, y in zip(ga, gb, strict=True)]


def fit(positive, unlabelled, moments=None, counted=None, seed: int = 11) -> Model:
    """Estimate the prior, then minimise the risk, with rows drawn from two samples (arrays or ``Rows``).

    ``moments`` (mean, scale) and ``counted`` (a ranker and cuts give the number of rows above each cut, and of all)
    come from all unlabelled rows; without them the samples stand for all.
    """
    p, u = _rows(positive), _rows(unlabelled)
    if moments is None:
        both = np.concatenate((p.x, u.x))
        moments = both.mean(axis=0), both.std(axis=0) + 1e-3
    mean, scale = moments
    rng = np.random.default_rng(seed)
    standard = lambda x: np.clip((x - mean) / scale, -8, 8)

    ranker = _start(rng, p.x.shape[1])
    adam = _Adam(ranker)
    for _ in range(STEPS // 2):
        a, b = standard(p.draw(rng, BATCH)), standard(u.draw(rng, BATCH))
        ga = (_sigmoid(_forward(ranker, a)[1]) - 1) / BATCH
        gb = _sigmoid(_forward(ranker, b)[1]) / BATCH
        adam.step([x + y for x, y in zip(_gradient(ranker, a, ga), _gradient(ranker, b, gb), strict=True)])
    first = Model(mean, scale, ranker, 0.5)
    ranks = np.round(first.score(p.x), 6)
    cuts = cuts_between(ranks, p.n)
    higher, rows = counted(first, cuts) if counted else (above(np.round(first.score(u.x), 6), u.n, cuts), int(u.n.sum()))
    prior = class_prior(above(ranks, p.n, cuts), int(p.n.sum()), higher, rows)

    layers = _start(rng, p.x.shape[1])
    adam = _Adam(layers)
    for _ in range(STEPS):
        grads = descent(layers, standard(p.draw(rng, BATCH)), standard(u.draw(rng, BATCH)), prior)
        adam.step([g + 1e-4 * w for g, w in zip(grads, layers, strict=True)])
    return Model(mean, scale, layers, prior)


def held_out(doc_id: Column | str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row's label must not be learnt from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def _sampled(df: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` of the different rows of ``df``, at most, with their copies."""
    share = min(1.0, sample / max(1, df.count()))
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit(5), *df.columns), 11) < F.lit(int(share * (1 << 53))))


def shapes(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every whole text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shape(t).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x binary")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, WIDTH).astype(np.float64)


def collected(made: DataFrame) -> Rows:
    """The different shapes of a bounded sample, on the driver, in an order of their own."""
    rows = sorted((bytes(r["x"]), r["n"]) for r in made.groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect())
    return Rows(_matrix([x for x, _ in rows]), np.array([n for _, n in rows], np.int64))


def moments(made: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and scale of each feature over all rows of ``made``, by sums of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.round(_matrix(batch.column(0).to_pylist()) * UNIT).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"feature": np.arange(WIDTH, dtype=np.int32), "n": np.full(WIDTH, len(x)), "total": x.sum(axis=0), "squares": (x * x).sum(axis=0)})

    parts = made.select("x").mapInArrow(run, "feature int, n long, total long, squares long")
    sums = parts.groupBy("feature").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "total", "squares")])
    rows = sorted(sums.collect())
    if not rows:
        return None
    mean = np.array([int(r["total"]) / int(r["n"]) / UNIT for r in rows])
    spread = [max(0, int(r["squares"]) * int(r["n"]) - int(r["total"]) ** 2) ** 0.5 / int(r["n"]) / UNIT for r in rows]
    return mean, np.array(spread) + 1e-3


def counted_above(made: DataFrame, model: Model, cuts: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows of ``made`` score each cut or more, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = np.round(model.score(_matrix(batch.column(0).to_pylist())), 6)
                found = above(scores, np.ones(len(scores), np.int64), cuts)
                yield pa.RecordBatch.from_pydict({"cut": np.arange(len(cuts) + 1, dtype=np.int32), "n": np.append(found, len(scores))})

    parts = made.select("x").mapInArrow(run, "cut int, n long")
    found = [r["n"] for r in parts.groupBy("cut").agg(F.sum("n").alias("n")).orderBy("cut").collect()]
    return np.array(found[:-1]), found[-1]


def _whole(x: np.ndarray, unit: float) -> np.ndarray:
    return np.round(x * unit)


def partial_gradient(layers: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """Of unlabelled rows: their number, the sum of their losses as negatives, and that sum's gradient, in whole numbers of the units."""
    z = _whole(z, FINE)
    hidden, out = _forward(layers, z / FINE)
    s = _sigmoid(out)
    slope = s * (1 - s)
    back, d = _whole(slope[:, None] * layers[2][None, :] * (1 - hidden**2), FINER), _whole(slope, FINER)
    parts = [np.array([len(z), _whole(s, FINER).sum()]), (z.T @ back).ravel(), back.sum(axis=0), _whole(hidden, FINER).T @ d, np.array([d.sum()])]
    return np.concatenate(parts).astype(np.int64)


def summed_gradient(made: DataFrame, model: Model) -> tuple[float, list[np.ndarray]]:
    """The mean loss of all rows of ``made`` as negatives, and its gradient by layer."""
    layers, mean, scale = model.layers, model.mean, model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(start, 4096).to_pylist())
                found = partial_gradient(layers, np.clip((x - mean) / scale, -8, 8))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(total), dtype=np.int32), "total": total})

    parts = made.select("x").mapInArrow(run, "place int, total long")
    sums = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()
    n, loss, *flat = (int(r["total"]) for r in sums)
    units = [FINE * FINER, FINER, FINER * FINER, FINER]
    out, at = [], 0
    for layer, unit in zip(layers, units, strict=True):
        out.append(np.array([x / unit / n for x in flat[at : at + layer.size]]).reshape(layer.shape))
        at += layer.size
    return loss / FINER / n, out


def refined(model: Model, positive: Rows, loss_of, passes: int = PASSES) -> Model:
    """``model`` after gradient steps on the risk of ``positive`` and all unlabelled rows; ``loss_of`` a model gives their mean loss and gradient."""
    z = np.clip((positive.x - model.mean) / model.scale, -8, 8)
    share, prior = positive.n / positive.n.sum(), model.prior
    now = Model(model.mean, model.scale, [x.copy() for x in model.layers], prior)
    adam, best, least = _Adam(now.layers, PASS_RATE), model, np.inf
    for _ in range(passes + 1):
        sa = _sigmoid(_forward(now.layers, z)[1])
        loss, gb = loss_of(now)
        below = loss - prior * float(share @ sa)
        found = prior * float(share @ (1 - sa)) + max(0.0, below)
        if found < least:
            best, least = Model(model.mean, model.scale, [x.copy() for x in now.layers], prior), found
        sign = 1.0 if below >= 0 else -1.0
        ga = _gradient(now.layers, z, (-2 if sign > 0 else 1) * prior * share * sa * (1 - sa))
        adam.step([a + sign * b + 1e-4 * w for a, b, w in zip(ga, gb, now.layers, strict=True)])
    return best


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) outside the held-out fold."""
    trusted = labels.where((F.col("quality") == 1) & ~held_out()).select("doc_id").where("doc_id is not null").distinct()
    chosen = F.broadcast(_sampled(trusted, sample))  # about ``sample`` ids
    web = written(shapes(docs.where(~held_out())), "shapes")
    try:
        positive = collected(_sampled(web.join(chosen, "doc_id", "left_semi"), sample))
        unlabelled = collected(_sampled(web, sample))
        if not len(positive.x) or not len(unlabelled.x):
            return None
        first = fit(positive, unlabelled, moments(web), lambda model, cuts: counted_above(web, model, cuts))
        return refined(first, positive, lambda model: summed_gradient(web, model))
    finally:
        discard(web)


def score(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """``docs`` with ``into``, from 0 to 1, by the whole text."""
    if into in docs.columns:
        raise ValueError(f"the input has a column {into} already")
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shape(t) for t in batch.column(place).to_pylist()]
            made = model.score(np.stack(x).astype(np.float32).astype(np.float64)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{into}` double")


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = train(docs, labels, sample)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
