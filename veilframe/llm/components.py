"""Connected components of a link table, by rounds of joins (large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour, itself included."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("m").alias("x"), F.col("b").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("a").alias("y"))
    return tied.union(own).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots: root is the least node reachable.

    Each round is written to the shared folder, so a lost executor costs one round at most and no
    links pass through the driver. The rounds end when a round changes nothing; a star for each
    component is then left. Null ends and links from a node to itself are dropped first.
    """
    now = written(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        after = written(_small_star(_large_star(now)), "links")
        sign = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if sign == before:
            found = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            found._veilframe_path = now._veilframe_path  # so that ``discard`` can end it
            return found
        before = sign
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
