"""Nearest neighbours by inner product: a vantage-point tree in each shard.

Vectors are dealt into shards of a bounded size by a hash of their id. The largest inner product
becomes the smallest Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2) with M the largest
length in the shard (a query has 0 there). A shard's tree halves its vectors at the median distance
from a vantage point. ``index`` builds each tree once, one row a shard, which can be kept and searched
again. A search visits the nearer half first and the other half only if the triangle inequality, with
the distance reached so far multiplied by ``factor``, cannot exclude it. With factor 1 the search is
exact; smaller factors skip more. The queries of a block walk a tree together, so that distances are
matrix products. The shards' best are then merged per query.

In a leaf the matrix product only rules vectors out, with an allowance for its rounding; for the rest the
score is computed as stated below, and the best are those with the largest scores, then the smallest ids,
however many vectors share the last place.

Every vector with finite components, none null, and not all zero is indexed; others take no part,
neither as candidates nor as queries. Equal vectors in a shard are one entry of its tree with their
smallest ids. The score is the inner product in double precision, summed in one fixed order, so
equal vectors tie exactly and ties go to the smaller id. Repeated rows (same id, same vector) are one
candidate, rows of one id with different vectors one each; a row is never its own candidate, by its id. Vectors whose number of components differs from
the query's are not its candidates. A null id takes no part. Fewer candidates than ``k``: all of them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.shared import written

#: Vectors of a shard, queries of a block and of a step inside a task, vectors of a leaf.
SHARD, QUERIES, STEP, LEAF = 16_384, 16_384, 2_048, 512
#: The factor of the pruning. 1 is exact, whatever the vectors' lengths: with smaller ones recall falls where they differ.
FACTOR = 1.0
#: Scores computed in one step.
PAIRS = 1 << 17


def _scores(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order."""
    parts = [np.einsum("ij,ij->i", x[i[k : k + PAIRS]], y[j[k : k + PAIRS]], optimize=False) for k in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Tree:
    """A vantage-point tree over different vectors, each with the ids that have it, smallest first."""

    def __init__(self, vectors: np.ndarray, least: np.ndarray, leaf: int = LEAF):
        """``least``: the smallest id of each vector."""
        self.vectors, self.least, self.leaf = vectors, least, leaf
        lengths = (vectors**2).sum(axis=1)
        self.top = float(lengths.max())
        self.points = np.concatenate((vectors, np.sqrt(np.maximum(0, self.top - lengths))[:, None]), axis=1)
        self.order = np.arange(len(vectors))
        #: Per node: first and last place, the vantage point's row (-1 in a leaf), the radius, and the two halves' nodes.
        self.nodes: list[tuple[int, int, int, float, int, int]] = []
        self._build(0, len(vectors))

    def _build(self, low: int, high: int) -> int:
        at = len(self.nodes)
        self.nodes.append((low, high, -1, 0.0, -1, -1))
        if high - low > self.leaf:
            rows = self.order[low:high]
            centre = self.points[rows].mean(axis=0)
            vantage = int(rows[np.argmax(((self.points[rows] - centre) ** 2).sum(axis=1))])
            away = np.sqrt(((self.points[rows] - self.points[vantage]) ** 2).sum(axis=1))
            ranks = np.argsort(away, kind="stable")
            self.order[low:high] = rows[ranks]
            middle = (low + high) // 2
            radius = float(away[ranks[middle - low - 1]] + away[ranks[middle - low]]) / 2
            self.nodes[at] = (low, high, vantage, radius, self._build(low, middle), self._build(middle, high))
        return at

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows of the ``k`` best found per query, by score, then smallest id; missing: minus infinity and -1."""
        best, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, dtype=np.int64)
        lengths = (queries**2).sum(axis=1)
        slack = 1e-12 * (self.top + lengths)  # what a matrix product may be off
        no_id = np.iinfo(np.int64).max

        def leaf(low: int, high: int, who: np.ndarray) -> None:
            rows = self.order[low:high]
            about = queries[who] @ self.vectors[rows].T
            i, j = np.nonzero(about >= (best[who, -1] - slack[who])[:, None])
            if about.shape[1] > k and len(i) > 4 * k * len(who):  # mostly before any is found: the leaf's own k-th best rules out most
                floor = np.partition(about, about.shape[1] - k, axis=1)[:, about.shape[1] - k]
                keep = about[i, j] >= (floor - 2 * slack[who])[i]
                i, j = i[keep], j[keep]
            if not len(i):
                return
            score = _scores(queries, self.vectors, who[i], rows[j])
            some, asker = np.unique(i, return_inverse=True)
            old = who[some]
            asker = np.concatenate((asker, np.repeat(np.arange(len(some)), k)))
            score = np.concatenate((score, best[old].ravel()))
            row = np.concatenate((rows[j], found[old].ravel()))
            ids = np.where(row >= 0, self.least[row], no_id)
            order = np.lexsort((ids, -score, asker))
            asker, score, row = asker[order], score[order], row[order]
            rank = np.arange(len(asker)) - np.searchsorted(asker, asker)
            top = rank < k
            best[old[asker[top]], rank[top]] = score[top]
            found[old[asker[top]], rank[top]] = row[top]

        def walk(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            low, high, vantage, radius, inner, outer = self.nodes[node]
            if vantage < 0:
                leaf(low, high, who)
                return
            point = self.points[vantage]
            away = np.sqrt(np.maximum(0, lengths[who] + self.top - 2 * queries[who] @ point[:-1]))
            inside = away < radius
            walk(inner, who[inside])
            walk(outer, who[~inside])
            # the distance of the last place, with an allowance for rounding that keeps factor 1 exact
            reach = np.sqrt(np.maximum(0, lengths[who] + self.top - 2 * best[who, -1])) * factor + 1e-6 * np.sqrt(self.top + lengths[who])
            walk(outer, who[inside & (radius - away <= reach)])
            walk(inner, who[~inside & (away - radius <= reach)])

        walk(0, np.arange(len(queries)))
        return best, found


class Shard:
    """One shard's tree and ids, made from rows and kept as bytes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        distinct, kind = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, kind.ravel()))
        kinds, self.ids = kind.ravel()[order], ids[order]
        self.starts = np.searchsorted(kinds, np.arange(len(distinct) + 1))
        self.tree = Tree(distinct, self.ids[self.starts[:-1]], leaf)

    def packed(self) -> bytes:
        return pickle.dumps(self, protocol=5)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pd.DataFrame:
        """The ``k`` best of the shard for each query (query_id, vec_id, score); a query is not its own candidate."""
        parts = []
        for at in range(0, len(queries), STEP):
            asked, names = queries[at : at + STEP], query_ids[at : at + STEP]
            best, rows = self.tree.search(asked, min(k + 1, len(self.tree.vectors)), factor)  # one more, as the query may be among them
            asker, place = np.nonzero(rows >= 0)
            near, score = rows[asker, place], best[asker, place]
            copies = np.minimum(self.starts[near + 1] - self.starts[near], k + 1)
            asker, score = np.repeat(asker, copies), np.repeat(score, copies)
            nth = np.arange(len(asker)) - np.repeat(np.cumsum(copies) - copies, copies)
            found = self.ids[np.repeat(self.starts[near], copies) + nth]
            other = found != names[asker]
            asker, found, score = asker[other], found[other], score[other]
            order = np.lexsort((found, -score, asker))
            asker, found, score = asker[order], found[order], score[order]
            top = np.arange(len(asker)) - np.searchsorted(asker, asker) < k
            parts.append(pd.DataFrame({"query_id": names[asker[top]], "vec_id": found[top], "score": score[top]}))
        return pd.concat(parts)


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, leaf: int = LEAF) -> pd.DataFrame:
    """The ``k`` best of one shard for each query (query_id, vec_id, score)."""
    return Shard(ids, vectors, leaf).search(query_ids, queries, k, factor)


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in rows])


def _deal(parts: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)).cast("int")


def _taking_part(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & usable("v")).withColumn("d", F.size("v"))


def index(vectors: DataFrame, shard: int = SHARD, leaf: int = LEAF, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(s, d, tree): a vantage-point tree of each shard and number of components, of every vector that takes part.

    A shard is some MB. Rows of one id in one shard that have equal vectors are one candidate; with different vectors each is one.
    """
    rows = _taking_part(vectors, vec_id, vector)
    dealt = rows.withColumn("s", _deal(max(1, -(-rows.count() // shard)), 1))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points, ids = _pack(pdf["v"]) + 0.0, pdf["id"].to_numpy(np.int64)
        both = np.unique(np.concatenate((ids[:, None].view(np.float64), points), axis=1).view(np.int64), axis=0, return_index=True)[1]
        return pd.DataFrame({"s": [key[0]], "d": [key[1]], "tree": [Shard(ids[both], points[both], leaf).packed()]})

    return dealt.groupBy("s", "d").applyInPandas(build, "s int, d int, tree binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard: int = SHARD, block: int = QUERIES, leaf: int = LEAF, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries``.

    The trees are built once and written to the shared folder; the queries are dealt into blocks by the hash of the
    id, and a task searches one tree for one block. The number of groups is the product of both counts, which is the
    work of a stated query set against all rows. Rows of ``queries`` with one id: the vector that compares smallest asks.
    """
    trees = written(index(vectors, shard, leaf, vec_id, vector), "trees")
    asked = _taking_part(queries, vec_id, vector).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    blocks = max(1, -(-asked.count() // block))
    left = trees.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("b", _deal(blocks, 2)).join(F.broadcast(trees.select((F.col("s") + 0).alias("s"), (F.col("d") + 0).alias("d"))), "d")  # a few bytes a shard

    def run(key: tuple, have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(want):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pickle.loads(have["tree"].iloc[0]).search(want["id"].to_numpy(np.int64), _pack(want["v"]), k, factor)

    groups = ["s", "b", "d"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
