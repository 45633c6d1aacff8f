"""Text and faces read from pixels: word lines, regions of images and screens, agreement with the markup, face boxes.

Words belong to a page (and an image); their number is bounded by what fits a picture, so the one fold that
depends on order, the assignment of words to lines, runs over one picture's words. The rest are joins by page
and expressions. Words with an empty or null text count as none for screens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.functions.text import digit_variant, normalised, same_text
from veilframe.operators import match

# Fixed values.
LINE_TOLERANCE, PAD, LONE_WORD, READ_SHARE, MERGE_SHARE = 0.6, 0.25, 3, 0.2, 0.6
DOCUMENT_WORDS = r"(?i)\b(aadhaar|aadhar|uidai|unique identification|income tax|permanent account number|passport|driving licen[cs]e|election commission|voter|government of india)\b"
LEAST_WIDTH, SCREEN_SCALE, MOST_PIXELS, SLACK = 1000, 2, 9_000_000, 1e-9
INPUT_WIDTH, INPUT_HEIGHT = 320, 240
STRIDES = (8, 16, 32, 64)
BOX_SIZES = ((10, 16, 24), (32, 48), (64, 96), (128, 192, 256))
CENTRE_VARIANCE, SIZE_VARIANCE, FACE_PAD, BLEED_PX = 0.1, 0.2, 0.15, 3
SEGMENTATION = {"screen": "11", "crop": "3"}
HAS_VALUE = "[has value]"


def lined(words: DataFrame, *keys: str) -> DataFrame:
    """``words`` (keys, ord, text, position) with ``line``: from top to bottom, then left to right, a word joins the first
    line whose first word's middle is near its own."""
    p = F.col("position")
    body = F.struct(p["y"].alias("y"), p["x"].alias("x"), "ord", "text", "position")
    grouped = words.groupBy(*keys).agg(F.array_sort(F.collect_list(body)).alias("_w"))
    middle = lambda w: w["y"] + w["position"]["height"] / 2
    start = F.struct(F.array().cast("array<struct<c:double,h:double>>").alias("heads"), F.array().cast("array<int>").alias("at"))

    def step(acc, w):
        near = F.transform(acc["heads"], lambda q: F.abs(q["c"] - middle(w)) <= F.greatest(q["h"], w["position"]["height"]) * LINE_TOLERANCE)
        found = F.array_position(near, F.lit(True)).cast("int")
        head = F.array(F.struct(middle(w).alias("c"), w["position"]["height"].alias("h")))
        return F.struct(
            F.when(found > 0, acc["heads"]).otherwise(F.concat(acc["heads"], head)).alias("heads"),
            F.concat(acc["at"], F.array(F.when(found > 0, found).otherwise(F.size(acc["heads"]) + 1))).alias("at"),
        )

    at = F.aggregate("_w", start, step, lambda acc: acc["at"])
    return grouped.select(*keys, F.inline(F.arrays_zip(F.col("_w").alias("w"), at.alias("line")))).select(*keys, "line", "w.ord", "w.text", "w.position")


def line_boxes(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, text, words, position): each line's words from left to right, and the box around them."""
    p = F.col("position")
    left, top = F.min(p["x"]), F.min(p["y"])
    box = geom.rect(left, top, F.max(p["x"] + p["width"]) - left, F.max(p["y"] + p["height"]) - top)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(p["x"].alias("x"), p["y"].alias("y"), "ord", "text"))), lambda w: w["text"]), " ")
    return lined(words, *keys).groupBy(*keys, "line").agg(said.alias("text"), F.count(F.lit(1)).alias("words"), box.alias("position"))


def image_regions(words: DataFrame, images: DataFrame, classify) -> DataFrame:
    """Regions of text in images. ``words``: page_id, element_id, ord, text, position in the crop; ``images``: page_id,
    element_id, position on the page, crop_width, crop_height. ``classify`` makes STRUCT<category, confidence> or null of a text.

    A line counts as it reads, or with look-alike characters as digits. An identity document covers the whole image.
    """
    read = line_boxes(words, "page_id", "element_id").withColumn("_hit", F.coalesce(classify(F.col("text")), classify(digit_variant(F.col("text")))))
    met = read.join(images.where("crop_width > 0 and crop_height > 0").withColumnRenamed("position", "_image"), ["page_id", "element_id"])
    sx, sy = F.col("_image.width") / F.col("crop_width"), F.col("_image.height") / F.col("crop_height")
    box = geom.pad(F.col("position"), F.col("position.height") * PAD)
    placed = geom.moved(geom.scale(box, sx, sy), F.col("_image.x"), F.col("_image.y"))
    line = met.where("_hit is not null").select("page_id", "element_id", F.concat_ws("-", F.lit("ocr"), "element_id", (F.col("line") - 1).cast("string")).alias("region_id"), "_hit.category", "_hit.confidence", placed.alias("position"))
    identity = F.coalesce(F.col("text").rlike(DOCUMENT_WORDS), F.lit(False)) | F.coalesce(F.col("_hit.category") == "id_number", F.lit(False))
    whole = met.where(identity).groupBy("page_id", "element_id").agg(F.first("_image").alias("position"))
    card = whole.select("page_id", "element_id", F.concat_ws("-", F.lit("ocr"), "element_id", F.lit("document")).alias("region_id"), F.lit("id_number").alias("category"), F.lit(0.9).alias("confidence"), "position")
    return line.unionByName(card).withColumn("source", F.lit("ocr"))


def pixel_detections(words: DataFrame, frames: DataFrame, classify) -> DataFrame:
    """(page_id, element_id, category, position): what readings of whole pictures (page_id, ord, text, position) find, to be scored by
    place alone: ``frames`` (page_id, width, height) are read as they are, and element_id is null."""
    whole = frames.select("page_id", F.lit("frame").alias("element_id"), geom.rect(0, 0, F.col("width"), F.col("height")).alias("position"), F.col("width").alias("crop_width"), F.col("height").alias("crop_height"))
    found = image_regions(words.withColumn("element_id", F.lit("frame")), whole, classify)
    return found.select("page_id", F.lit(None).cast("string").alias("element_id"), "category", "position")


def covered_images(images: DataFrame, results: DataFrame) -> DataFrame:
    """Images to cover whole: those without a result (page_id, element_id, ok), or with one that failed."""
    read = results.groupBy("page_id", "element_id").agg(F.bool_and("ok").alias("_ok"))
    bad = images.join(read, ["page_id", "element_id"], "left").where(~F.coalesce("_ok", F.lit(False)))
    return bad.select("page_id", "element_id", F.lit("other").alias("category"), F.lit(1.0).alias("confidence"), F.lit("ocr").alias("source"), "position")


def to_read(images: DataFrame, read: DataFrame, view: Column) -> DataFrame:
    """Images wholly inside ``view`` that were not read whole before (page_id, element_id)."""
    p = F.col("position")
    inside = (p["x"] >= view["x"]) & (p["y"] >= view["y"]) & (p["x"] + p["width"] <= view["x"] + view["width"]) & (p["y"] + p["height"] <= view["y"] + view["height"])
    return images.where(inside).join(read, ["page_id", "element_id"], "left_anti")


def screen_lines(words: DataFrame, frame: Column, view: Column) -> DataFrame:
    """(page_id, text, words, position, place): lines of a screen in reading order, in the view's units; short lone words go."""
    said = words.withColumn("text", F.trim("text")).where("text <> ''")
    lines = line_boxes(said, "page_id").where((F.col("words") > 1) | (F.length("text") >= LONE_WORD))
    placed = lines.withColumn("position", geom.scale(F.col("position"), view["width"] / frame["width"], view["height"] / frame["height"]))
    order = Window.partitionBy("page_id").orderBy("position.y", "position.x", "line")
    return placed.withColumn("place", F.row_number().over(order)).drop("line")


def shown_texts(elements: DataFrame) -> DataFrame:
    """(page_id, ord, element_id, text, position): what elements show; an empty value hides a label, passwords show nothing."""
    text = F.coalesce("value", "label", "placeholder")
    rows = elements.where(~F.coalesce(F.col("input_type") == "password", F.lit(False))).withColumn("text", text)
    return rows.where((F.trim("text") != "") & (F.col("text") != HAS_VALUE)).select("page_id", "ord", "element_id", "text", "position")


def merged_sightings(items: DataFrame, share: float = MERGE_SHARE) -> DataFrame:
    """The first of sightings (page_id, ord, text, position) with one normalised text that cover ``share`` of the smaller; texts without letters or digits are none."""
    named = items.withColumn("_text", normalised(F.col("text"))).where("_text <> ''")
    return match.kept_first(named, [F.col("ord")], lambda k, x: geom.overlap_share(k["position"], x["position"]) >= share, "page_id", "_text").drop("_text")


def agreed_pairs(shown: DataFrame, read: DataFrame, share: float = READ_SHARE, key: str = "page_id") -> DataFrame:
    """(page_id, a, b, weight): texts of the markup (ord a) and of the pixels (ord b) that say the same in one place, one to one, the best overlap first."""
    near = match.overlapping(shown, read, key)
    weight = geom.overlap_share(F.col("l.position"), F.col("r.position"))
    pairs = near.where((weight >= share) & same_text(F.col("l.text"), F.col("r.text"))).select(key, F.col("l.ord").alias("a"), F.col("r.ord").alias("b"), weight.alias("weight"))
    return match.greedy_pairs(pairs, key)


def compared(items: DataFrame, share: float = READ_SHARE, key: str = "page_id") -> DataFrame:
    """(page_id, agreed, shown_only, read_only, agreement, hidden) of pages with texts (page_id, side, ord, text in normal form,
    position) of the markup (side 0) or the pixels (side 1), one to one as in ``agreed_pairs``; those of side 2 are only counted.

    A page's texts are gathered once and paired in place. Its first pair is kept whether it agrees or not, so that pages
    where none does keep their counts.
    """
    side = lambda n: F.collect_list(F.when(F.col("side") == n, F.struct("ord", "text", "position")))
    pages = items.groupBy(key).agg(side(0).alias("_l"), side(1).alias("_r"), F.count_if(F.col("side") == 2).alias("hidden")).where("size(_l) + size(_r) > 0")
    left = pages.select(key, "hidden", F.size("_l").cast("long").alias("shown"), F.size("_r").cast("long").alias("read"), F.posexplode_outer("_l").alias("i", "l"), "_r")
    near = left.select(key, "hidden", "shown", "read", "i", "l", F.posexplode_outer("_r").alias("j", "r"))
    weight = geom.overlap_share(F.col("l.position"), F.col("r.position"))
    within = F.col("l.text").contains(F.col("r.text")) | F.col("r.text").contains(F.col("l.text"))
    agrees = F.col(key).isNotNull() & (weight >= share) & (F.col("l.text") != "") & (F.col("r.text") != "") & within
    first = (F.coalesce("i", F.lit(0)) == 0) & (F.coalesce("j", F.lit(0)) == 0)
    pairs = F.array_sort(F.collect_list(F.when(agrees, F.struct((-weight).alias("w"), F.col("l.ord").alias("a"), F.col("r.ord").alias("b")))))
    told = near.where(first | agrees).groupBy(key, "shown", "read", "hidden").agg(pairs.alias("_pairs"))
    kind = told.schema["_pairs"].dataType.elementType.simpleString()
    agreed = F.size(match.kept(F.col("_pairs"), kind, match.taken)).cast("long")
    rows = told.withColumn("agreed", agreed).select(key, "agreed", (F.col("shown") - F.col("agreed")).alias("shown_only"), (F.col("read") - F.col("agreed")).alias("read_only"), "hidden")
    total = F.col("agreed") + F.col("shown_only") + F.col("read_only")
    return rows.select(key, "agreed", "shown_only", "read_only", F.when(total > 0, F.col("agreed") / total).otherwise(1.0).alias("agreement"), "hidden")


def agreement(shown: DataFrame, read: DataFrame, share: float = READ_SHARE) -> DataFrame:
    """(page_id, agreed, shown_only, read_only, agreement): texts of the markup and of the pixels (page_id, ord, text, position), one to one by overlap."""
    of = lambda df, n: df.select("page_id", F.lit(n).alias("side"), "ord", normalised(F.col("text")).alias("text"), "position")
    return compared(of(shown.where(F.trim("text") != ""), 0).union(of(read, 1)), share).drop("hidden")


def recognition_size(width: Column, height: Column, least_width: Column | None = None, scale: Column | None = None) -> Column:
    """STRUCT<width, height, scale, capped>: how large to read a picture, within a number of pixels."""
    w, h = F.greatest(F.lit(0), F.round(width)).cast("long"), F.greatest(F.lit(0), F.round(height)).cast("long")
    wanted = F.greatest(F.lit(1.0), F.coalesce((least_width if least_width is not None else w) / w, F.lit(1.0)), scale.cast("double") if scale is not None else F.lit(1.0))
    room = F.sqrt(F.lit(float(MOST_PIXELS)) / (w * h))
    by = F.greatest(F.lit(1.0), F.least(wanted, room))
    near = lambda v: F.floor(v + 0.5).cast("long")
    full = F.struct(near(w * by).alias("width"), near(h * by).alias("height"), by.alias("scale"), (by < wanted - SLACK).alias("capped"))
    none = F.struct(F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("height"), F.lit(1.0).alias("scale"), F.lit(False).alias("capped"))
    return F.when((w > 0) & (h > 0), full).otherwise(none)


def priors(spark: SparkSession) -> DataFrame:
    """(prior, cx, cy, width, height): the grid of anchor boxes by the fixed strides and sizes, 4,420 of them in their order."""
    heads = spark.createDataFrame([(n, s, list(b)) for n, (s, b) in enumerate(zip(STRIDES, BOX_SIZES, strict=True))], "head int, stride int, sizes array<int>")
    across, down = F.lit(INPUT_WIDTH) / F.col("stride"), F.lit(INPUT_HEIGHT) / F.col("stride")
    grid = heads.select("*", F.explode(F.sequence(F.lit(0), F.ceil(down).cast("int") - 1)).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.ceil(across).cast("int") - 1)).alias("column"))
    boxes = grid.select("head", "stride", "row", "column", F.posexplode("sizes").alias("n", "size"))
    number = F.row_number().over(Window.orderBy("head", "row", "column", "n")) - 1
    return boxes.select(number.alias("prior"), ((F.col("column") + 0.5) / across).alias("cx"), ((F.col("row") + 0.5) / down).alias("cy"), (F.col("size") / INPUT_WIDTH).alias("width"), (F.col("size") / INPUT_HEIGHT).alias("height"))


def decoded(raw: DataFrame, grid: DataFrame) -> DataFrame:
    """``raw`` (prior, dx, dy, dw, dh, ...) with ``box``: STRUCT<x1, y1, x2, y2>, joined to the grid, which is broadcast (4,420 rows)."""
    met = raw.join(F.broadcast(grid), "prior")
    cx, cy = F.col("dx") * CENTRE_VARIANCE * F.col("width") + F.col("cx"), F.col("dy") * CENTRE_VARIANCE * F.col("height") + F.col("cy")
    w, h = F.exp(F.col("dw") * SIZE_VARIANCE) * F.col("width"), F.exp(F.col("dh") * SIZE_VARIANCE) * F.col("height")
    box = F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))
    return met.select(*raw.columns, box.alias("box"))


def padded_face(box: Column, by: float = FACE_PAD) -> Column:
    """A face box grown on all sides, kept inside the frame (0 to 1)."""
    w, h = (box["x2"] - box["x1"]) * by, (box["y2"] - box["y1"]) * by
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.struct(unit(box["x1"] - w).alias("x1"), unit(box["y1"] - h).alias("y1"), unit(box["x2"] + w).alias("x2"), unit(box["y2"] + h).alias("y2"))


def face_position(box: Column, width: Column, height: Column, scale_x: Column, scale_y: Column) -> Column:
    """A box (0 to 1) of a frame in page units; null for a frame that was never measured."""
    place = geom.rect(box["x1"] * width / scale_x, box["y1"] * height / scale_y, (box["x2"] - box["x1"]) * width / scale_x, (box["y2"] - box["y1"]) * height / scale_y)
    return F.when((width > 0) & (height > 0) & (scale_x > 0) & (scale_y > 0), place)


def device_box(r: Column, scale_x: Column, scale_y: Column, width: Column, height: Column, bleed: float = BLEED_PX) -> Column:
    """A page rectangle in the frame's pixels, a little larger, inside the frame."""
    left, top = F.greatest(F.lit(0.0), r["x"] * scale_x - bleed), F.greatest(F.lit(0.0), r["y"] * scale_y - bleed)
    right, bottom = F.least(width.cast("double"), (r["x"] + r["width"]) * scale_x + bleed), F.least(height.cast("double"), (r["y"] + r["height"]) * scale_y + bleed)
    return geom.rect(left, top, right - left, bottom - top)


def painted(regions: DataFrame, frames: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, painted, skipped): rectangles that can be painted in their frame (page_id, scale_x, scale_y, width, height), and those outside it."""
    box = device_box(F.col("position"), F.col("scale_x"), F.col("scale_y"), F.col("frame_width"), F.col("frame_height"))
    rows = regions.join(frames, key).withColumn("_box", box)
    good = (F.col("_box.width") > 0) & (F.col("_box.height") > 0)
    return rows.groupBy(key).agg(F.count_if(good).alias("painted"), F.count_if(~good).alias("skipped"))
