"""A whole page read in several looks: which looks count, everything lifted into the page's space, one result of all.

``captures``: page_id, stop, scroll_x, scroll_y, view_width, view_height, ok, one row a look. ``findings`` (stop, ord,
category, source, reason), ``images``, ``shown`` and ``read`` texts carry the stop that saw them and a position in that
look's view. A look is joined to its rows by page and stop, so pages never meet, and what overlapping looks saw twice is
merged in the page's space, the earlier sighting first. Nothing is summed over looks.

A walk ends before a look at which the page was lost (no scroll_y), did not move, or could not be read (ok false or
null); rows of looks that don't count are left out, as are those of unknown stops. Nothing found, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.functions.text import normalised
from veilframe.operators import coverage, match, vision

LOOK = ("stop", "scroll_x", "scroll_y", "view_width", "view_height")
UNREAD = "image never wholly in view and not read"


def walked(captures: DataFrame, key: str = "page_id") -> DataFrame:
    """The looks that count, with ``short``: whether the walk ended before its last planned look."""
    order = Window.partitionBy(key).orderBy("stop", "scroll_y")
    still = F.coalesce(F.col("scroll_y") == F.lag("scroll_y").over(order), F.lit(False))
    rows = captures.withColumn("_bad", (F.col("scroll_y").isNull() | still | ~F.coalesce(F.col("ok"), F.lit(False))).cast("int"))
    ended = F.max("_bad").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    short = F.max("_bad").over(Window.partitionBy(key)) == 1
    return rows.withColumns({"_ended": ended, "short": short}).where("_ended = 0").select(key, *LOOK, "short")


def view_of(look: str | None = None) -> Column:
    """The rectangle of a look in the page's space."""
    c = lambda n: F.col(f"{look}.{n}" if look else n)
    return geom.rect(c("scroll_x"), c("scroll_y"), c("view_width"), c("view_height"))


def lifted(rows: DataFrame, looks: DataFrame, key: str = "page_id") -> DataFrame:
    """``rows`` of looks that count, their position moved from the view to the page.

    A page's few looks are met as one list, so the rows are dealt by page alone, as what follows needs them, and not again.
    """
    views = looks.groupBy(key).agg(F.collect_list(F.struct("stop", "scroll_x", "scroll_y")).alias("_views"))
    met = rows.join(views, key).withColumn("_view", F.explode(F.filter("_views", lambda v: v["stop"] == F.col("stop"))))
    return met.withColumn("position", geom.moved(F.col("position"), F.col("_view.scroll_x"), F.col("_view.scroll_y"))).select(*rows.columns)


def stitched(findings: DataFrame, looks: DataFrame, share: float = match.SAME_SHARE, key: str = "page_id") -> DataFrame:
    """Findings of all looks in the page's space: of those of one category that cover ``share`` of the smaller, the earliest."""
    same = lambda k, x: geom.overlap_share(k["position"], x["position"]) >= share
    return match.kept_first(lifted(findings, looks, key), [F.col("stop"), F.col("ord")], same, key, "category")


def images_seen(images: DataFrame, looks: DataFrame, level: str = "standard", key: str = "page_id") -> DataFrame:
    """(page_id, ord, seen_whole, position): each image large enough once a look, in the order of the looks, in the page's space."""
    p = F.col("position")
    met = coverage.image_candidates(images, level).join(looks.select(key, *LOOK), [key, "stop"])
    whole = (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] + p["width"] <= F.col("view_width")) & (p["y"] + p["height"] <= F.col("view_height"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("stop", "ord")).cast("long")
    return met.select(key, number.alias("ord"), whole.alias("seen_whole"), geom.moved(p, F.col("scroll_x"), F.col("scroll_y")).alias("position"))


def crops(images: DataFrame, looks: DataFrame, results: DataFrame, level: str = "standard", key: str = "page_id") -> DataFrame:
    """(page_id, stop, element_id): images to read at each look: those wholly inside it that no earlier look read whole.

    ``results`` (page_id, stop, element_id, ok): a read that failed, or has no result, is tried again at the next look.
    """
    p = F.col("position")
    view = geom.rect(0, 0, F.col("view_width"), F.col("view_height"))
    met = coverage.image_candidates(images, level).join(looks.select(key, *LOOK), [key, "stop"])
    inside = (p["x"] >= view["x"]) & (p["y"] >= view["y"]) & (p["x"] + p["width"] <= view["width"]) & (p["y"] + p["height"] <= view["height"])
    read = results.groupBy(key, "stop", "element_id").agg(F.bool_and("ok").alias("_ok"))
    rows = met.where(inside).select(key, "stop", "element_id").distinct().join(read, [key, "stop", "element_id"], "left")
    before = Window.partitionBy(key, "element_id").orderBy("stop").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.coalesce("_ok", F.lit(False))).over(before), F.lit(False))
    return rows.withColumn("_done", done).where("not _done").select(key, "stop", "element_id")


def everything(findings: DataFrame, images: DataFrame, looks: DataFrame, level: str = "standard", key: str = "page_id") -> DataFrame:
    """(page_id, stop, ord, category, source, reason, position): the stitched findings, then images that no look saw whole and nothing read.

    The latter have no stop. They are gaps, and are never merged into a finding.
    """
    columns = [key, "stop", "ord", "category", "source", "reason", "position"]
    found = stitched(findings, looks, key=key).select(*columns)
    unread = coverage.unexamined(images_seen(images, looks, level, key), found.select(key, "source", "position"), key=key)
    gap = unread.select(key, F.lit(None).cast(found.schema["stop"].dataType).alias("stop"), F.col("ord").cast(found.schema["ord"].dataType).alias("ord"), F.lit("other").alias("category"), F.lit("ocr").alias("source"), F.lit(UNREAD).alias("reason"), "position")
    return found.unionByName(gap)


def screens(found: DataFrame, looks: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, stop, covered): how many findings of the whole page each look shows; all of them are to be painted there."""
    views = looks.select(key, "stop", view_of().alias("view"))
    seen = coverage.clipped(found.select(key, "position"), views, key).groupBy(key, "stop").agg(F.count(F.lit(1)).alias("n"))
    return looks.select(key, "stop").join(seen, [key, "stop"], "left").select(key, "stop", F.coalesce("n", F.lit(0).cast("long")).alias("covered"))


def reading(shown: DataFrame, read: DataFrame, hidden: DataFrame, looks: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, agreed, shown_only, read_only, agreement, hidden) of each page: both readers' texts (page_id, stop, ord, text,
    position) of all looks, sightings merged first and compared once; ``hidden`` counts different pieces.

    Texts are brought to their normal form, then dealt by page, once; sightings are merged and compared where they then lie.
    """
    sides = [rows.select(key, F.lit(n).alias("side"), "stop", "ord", normalised(F.col("text")).alias("text"), "position").where("text <> ''") for n, rows in enumerate((shown, read, hidden))]
    pieces = sides[0].union(sides[1]).union(sides[2]).repartition(key)
    same = lambda k, x: geom.overlap_share(k["position"], x["position"]) >= vision.MERGE_SHARE
    merged = match.kept_first(lifted(pieces, looks, key), [F.col("stop"), F.col("ord")], same, key, "side", "text")
    number = F.row_number().over(Window.partitionBy(key, "side").orderBy("stop", "ord", "text", "position")).cast("long")
    return vision.compared(merged.withColumn("ord", number), key=key)


def screen_findings(shown: DataFrame, read: DataFrame, classify, *keys: str) -> DataFrame:
    """(keys, ord, category, confidence, source, reason, position): texts that only the pixels of a screen show and that hold
    personal data. ``classify`` makes STRUCT<category, confidence, reason> or null of a text; ``keys`` name one screen."""
    one = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    left, right = shown.withColumn("_screen", one), read.withColumn("_screen", one)
    agreed = vision.agreed_pairs(left, right, key="_screen").select("_screen", F.col("b").alias("ord"))
    hits = right.join(agreed, ["_screen", "ord"], "left_anti").withColumn("_hit", classify(F.col("text"))).where("_hit is not null")
    return hits.select(*keys, "ord", "_hit.category", "_hit.confidence", F.lit("ocr").alias("source"), F.concat(F.lit("text on screen with no element, "), F.col("_hit.reason")).alias("reason"), "position")


def summary(found: DataFrame, looks: DataFrame, plans: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, stops, looks, document_height, view_height, truncated, examined_to, total, counts) of each page of ``plans``
    (page_id, stops: their number, document_height, view_height, truncated); ``counts`` is by category."""
    walk = looks.groupBy(key).agg(F.count(F.lit(1)).alias("looks"), F.max_by(F.col("scroll_y") + F.col("view_height"), "stop").alias("examined_to"), F.max("short").alias("short"))
    tally = found.groupBy(key, "category").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"))
    rows = plans.join(walk, key, "left").join(tally, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return rows.select(
        key,
        "stops",
        zero("looks").alias("looks"),
        "document_height",
        "view_height",
        (F.col("truncated") | F.coalesce("short", F.lit(True))).alias("truncated"),
        F.coalesce(F.col("examined_to").cast("long"), F.lit(0).cast("long")).alias("examined_to"),
        zero("total").alias("total"),
        F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"),
    )
