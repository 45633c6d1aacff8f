"""What a whole-page scan covers: stops, image candidates, clipped findings, images never examined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import geom

#: Floors of image candidates by level, their proportions, stops, stride, and tolerance of a whole view.
FLOORS = {"standard": (140, 80), "thorough": (100, 57), "maximum": (40, 23)}
LEAST_ASPECT, MOST_ASPECT, MOST_STOPS, STRIDE, WHOLE = 0.25, 4.0, 12, 0.75, 24
SWEEP = (40, 60, 80, 100, 120, 140, 180, 240)


def floor_for(level: str) -> tuple[int, int]:
    return FLOORS.get(level, FLOORS["standard"])


def scan_stops(height: Column, view: Column) -> tuple[Column, Column]:
    """Scroll stops of a page and whether they end before its bottom."""
    bottom = F.greatest(F.lit(0), height - view).cast("int")
    stride = F.greatest(F.lit(1), F.floor(view * F.lit(STRIDE) + 0.5).cast("int"))
    regular = F.slice(F.sequence(F.lit(0), bottom, stride), 1, MOST_STOPS)
    last = F.element_at(regular, -1)
    cut = (F.size(regular) >= MOST_STOPS) & (last < bottom)
    return F.when(cut | (last == bottom), regular).otherwise(F.concat(regular, F.array(bottom))), cut


def is_candidate(position: Column, width: Column, height: Column) -> Column:
    aspect = position["width"] / position["height"]
    return (position["width"] >= width) & (position["height"] >= height) & (position["height"] > 0) & aspect.between(LEAST_ASPECT, MOST_ASPECT)


def image_candidates(elements: DataFrame, level: str = "standard") -> DataFrame:
    width, height = floor_for(level)
    return elements.where((F.col("element_type") == "image") & is_candidate(F.col("position"), F.lit(width), F.lit(height)))


def floor_sweep(images: DataFrame, widths=SWEEP) -> DataFrame:
    """(floor, crops): candidates at each floor width, its height in proportion; the list of widths is fixed and short."""
    floors = images.sparkSession.createDataFrame([(w,) for w in widths], "floor int")
    height = F.floor(F.col("floor") * 80 / F.lit(140) + 0.5)
    met = images.join(F.broadcast(floors), is_candidate(F.col("position"), F.col("floor"), height))
    counted = met.groupBy("floor").agg(F.count(F.lit(1)).alias("crops"))
    return floors.join(counted, "floor", "left").select("floor", F.coalesce("crops", F.lit(0).cast("long")).alias("crops"))


def floor_costs(images: DataFrame, widths=SWEEP, shipped: int = FLOORS["standard"][0]) -> DataFrame:
    """What each floor width of the sweep catches of images (position, sensitive), and its crops against those of ``shipped``.

    One pass counts all widths; without sensitive images, crops or crops at ``shipped`` a ratio is 1.
    """
    yes = F.coalesce(F.col("sensitive"), F.lit(False))
    sums = [F.count_if(yes).alias("sensitive")]
    for w in {*widths, shipped}:
        met = is_candidate(F.col("position"), F.lit(w), F.lit(int(w * 80 / 140 + 0.5)))
        sums += [F.count_if(met).alias(f"_n{w}"), F.count_if(met & yes).alias(f"_c{w}")]
    rows = [F.struct(F.lit(w).alias("floor"), F.col(f"_n{w}").alias("crops"), F.col(f"_c{w}").alias("caught"), F.col("sensitive"), F.col(f"_n{shipped}").alias("_base")) for w in widths]
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    told = images.agg(*sums).select(F.inline(F.array(*rows)))
    return told.select("floor", "crops", "caught", "sensitive", ratio("caught", "sensitive").alias("recall"), (F.col("crops") - F.col("caught")).alias("over_flagged"), ratio("caught", "crops").alias("precision"), ratio("crops", "_base").alias("relative_cost"))


def clipped(findings: DataFrame, views: DataFrame, key: str = "page_id") -> DataFrame:
    """Findings in each view of their page, in its coordinates; those outside go."""
    inside = geom.clip(F.col("position"), F.col("view"))
    rows = findings.join(views, key).withColumn("position", inside).where("position.width > 0 and position.height > 0")
    return rows.withColumn("position", geom.moved(F.col("position"), -F.col("view.x"), -F.col("view.y")))


def looked_at(images: DataFrame, share: float = 0.6, key: str = "page_id") -> DataFrame:
    """Images (page_id, ord, seen_whole, position) of several looks merged: a later one that covers ``share`` of the smaller is
    the same image, and was seen whole if any look saw it whole. The first look's place stays."""
    body = F.array_sort(F.collect_list(F.struct("ord", "seen_whole", "position")))
    kept = F.array().cast("array<struct<ord:bigint,seen_whole:boolean,position:struct<x:double,y:double,width:double,height:double>>>")

    def step(acc, x):
        near = F.transform(acc, lambda k: geom.overlap_share(k["position"], x["position"]) >= share)
        at = F.array_position(near, F.lit(True))
        seen = F.transform(acc, lambda k, i: F.struct(k["ord"].alias("ord"), (k["seen_whole"] | ((i + 1 == at) & x["seen_whole"])).alias("seen_whole"), k["position"].alias("position")))
        new = F.struct(x["ord"].cast("bigint").alias("ord"), x["seen_whole"].alias("seen_whole"), x["position"].alias("position"))
        return F.when(at > 0, seen).otherwise(F.concat(acc, F.array(new)))

    return images.groupBy(key).agg(body.alias("_i")).select(key, F.inline(F.aggregate("_i", kept, step)))


def unexamined(images: DataFrame, findings: DataFrame, share: float = 0.6, key: str = "page_id") -> DataFrame:
    """Images that no look saw whole and that no ``ocr`` finding covers."""
    read = findings.where(F.col("source") == "ocr").select(F.col(key).alias("_k"), F.col("position").alias("_p"))
    merged = looked_at(images, share, key).where(~F.col("seen_whole"))
    return merged.join(read, (F.col(key) == F.col("_k")) & (geom.overlap_share(F.col("position"), F.col("_p")) >= share), "left_anti")
