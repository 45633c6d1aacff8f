"""Boxes against boxes: joins by overlap, order-dependent folds, and greedy one-to-one matching.

All of them work inside a page (or another key), whose boxes are few; the key is an equi-join, so
pages are spread over the cluster and never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import geom

KEEP_SCORE, NMS_IOU, MOST_FACES, SAME_SHARE, PIXEL_IOU, READ_SHARE = 0.3, 0.3, 50, 0.6, 0.5, 0.2


def overlapping(left: DataFrame, right: DataFrame, key: str = "page_id") -> DataFrame:
    """Pairs of boxes of a page that share a positive area: ``l`` and ``r`` hold both rows."""
    a = left.select(key, F.struct(*left.columns).alias("l"))
    b = right.select(key, F.struct(*right.columns).alias("r"))
    return a.join(b, key).where(geom.overlaps(F.col("l.position"), F.col("r.position")))


def kept(items: Column, kind: str, clash) -> Column:
    """The items, in order, that clash with none kept before."""
    add = lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(items, F.array().cast(f"array<{kind}>"), add)


def _fold(rows: DataFrame, order: list[Column], clash, *keys: str, most: int | None = None) -> DataFrame:
    body = F.struct(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"), *[c for c in rows.columns if c not in keys])
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(body)).alias("items"))
    kind = grouped.schema["items"].dataType.elementType.simpleString()
    stay = kept(F.col("items"), kind, clash)
    return grouped.select(*keys, F.explode(F.slice(stay, 1, most) if most else stay).alias("x")).select(*keys, "x.*").drop("_o")


def kept_first(rows: DataFrame, order: list[Column], clash, *keys: str) -> DataFrame:
    """The rows, in order, that clash with none kept before, inside each group of ``keys``.

    A group is one page's (and category's or text's) rows, folded in one task: its size is bounded by what a page holds.
    """
    return _fold(rows, order, clash, *keys)


def suppressed(boxes: DataFrame, iou: float = NMS_IOU, least: float = KEEP_SCORE, most: int = MOST_FACES, key: str = "page_id") -> DataFrame:
    """Greedy suppression: by score, ties by ``ord``, boxes that overlap none kept by more than ``iou``."""
    return _fold(boxes.where(F.col("score") >= least), [-F.col("score"), F.col("ord")], lambda k, x: geom.iou(k["position"], x["position"]) > iou, key, most=most)


def deduplicated(findings: DataFrame, share: float = SAME_SHARE, key: str = "page_id") -> DataFrame:
    """The first of findings of one category that cover ``share`` or more of the smaller one."""
    return _fold(findings, [F.col("ord")], lambda k, x: geom.overlap_share(k["position"], x["position"]) >= share, key, "category")


def deduplicated_regions(regions: DataFrame, share: float = SAME_SHARE, key: str = "page_id") -> DataFrame:
    """Like ``deduplicated``, or of one element; manual regions always stay and hide none."""
    same = lambda k, x: F.coalesce(k["element_id"] == x["element_id"], F.lit(False)) | (geom.overlap_share(k["position"], x["position"]) >= share)
    manual = F.col("source") == "manual"
    rest = _fold(regions.where(~manual), [F.col("ord")], same, key, "category")
    return rest.unionByName(regions.where(manual))


def taken(k: Column, x: Column) -> Column:
    """Whether pair ``k`` has an end of pair ``x``."""
    return (k["a"] == x["a"]) | (k["b"] == x["b"])


def greedy_pairs(pairs: DataFrame, key: str = "page_id", weight: str = "weight") -> DataFrame:
    """One-to-one matching: pairs (a, b, weight) by weight, then a, then b, if neither end is taken."""
    return _fold(pairs, [-F.col(weight), F.col("a"), F.col("b")], taken, key)


def best_element(regions: DataFrame, elements: DataFrame, key: str = "page_id") -> DataFrame:
    """Per region the element that covers most of it, if over half, the first of equals."""
    share = F.when(geom.area(F.col("l.position")) > 0, geom.intersection(F.col("l.position"), F.col("r.position")) / geom.area(F.col("l.position"))).otherwise(0.0)
    near = overlapping(regions, elements, key).withColumn("share", share).where("share > 0.5")
    return near.groupBy(key, F.col("l.region_id").alias("region_id")).agg(F.max_by("r.element_id", F.struct("share", (-F.col("r.ord")))).alias("element_id"))
