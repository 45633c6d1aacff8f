"""Scores of detections against labels: per page, per category, summed up, and for naive baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.operators import match
from veilframe.operators.audit import rate


def _last_truth(truth: DataFrame) -> DataFrame:
    """Of repeated labels the last counts."""
    return truth.groupBy("page_id", "element_id").agg(F.max_by("category", "ord").alias("expected"))


def _first_flag(found: DataFrame) -> DataFrame:
    """Of repeated detections the first counts."""
    return found.where("element_id is not null").groupBy("page_id", "element_id").agg(F.min_by("category", "ord").alias("claimed"))


def compared(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, element_id, expected, claimed): one row per element that either side names."""
    return _last_truth(truth).join(_first_flag(found), ["page_id", "element_id"], "full")


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def _rates(rows: DataFrame) -> DataFrame:
    tp, fn, fp = F.col("true_positives"), F.col("false_negatives"), F.col("false_positives")
    out = rows.withColumn("recall", rate(tp, tp + fn)).withColumn("precision", rate(tp, tp + fp))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("category_accuracy", rate(F.col("right_category"), tp))


def scored(pairs: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates over ``compared`` rows: ratios of sums, so pages weigh by their labels."""
    both = F.col("expected").isNotNull() & F.col("claimed").isNotNull()
    return _rates(
        pairs.groupBy(*keys).agg(
            F.count_if(both).alias("true_positives"),
            F.count_if(F.col("claimed").isNull()).alias("false_negatives"),
            F.count_if(F.col("expected").isNull()).alias("false_positives"),
            F.count_if(both & (F.col("expected") == F.col("claimed"))).alias("right_category"),
        )
    )


def by_category(pairs: DataFrame) -> DataFrame:
    """Expected, found and falsely claimed per category; a false claim is charged to the claimed one."""
    expected = pairs.where("expected is not null").groupBy(F.col("expected").alias("category")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("claimed").isNotNull()).alias("true_positives"))
    false = pairs.where("expected is null").groupBy(F.col("claimed").alias("category")).agg(F.count(F.lit(1)).alias("false_positives"))
    zero = F.lit(0).cast("long")
    rows = expected.join(false, "category", "full").select("category", *[F.coalesce(c, zero).alias(c) for c in ("expected", "true_positives", "false_positives")])
    return rows.withColumn("recall", rate(F.col("true_positives"), F.col("expected"))).withColumn("precision", rate(F.col("true_positives"), F.col("true_positives") + F.col("false_positives")))


#: Naive strategies: whether one would hide an element.
BASELINES = {
    "none": lambda: F.lit(False),
    "blanket": lambda: F.lit(True),
    "all_inputs": lambda: F.col("element_type") == "input",
    "all_values": lambda: F.coalesce(F.col("value") != "", F.lit(False)),
}


def baselines(elements: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """Rates of each strategy and of the detector, with the share of harmless elements it leaves readable."""
    labelled = elements.join(_last_truth(truth), ["page_id", "element_id"], "left").join(_first_flag(found), ["page_id", "element_id"], "left")
    hides = F.array(*[F.struct(F.lit(n).alias("strategy"), f().alias("hidden")) for n, f in BASELINES.items()], F.struct(F.lit("detector").alias("strategy"), F.col("claimed").isNotNull().alias("hidden")))
    rows = labelled.select("expected", F.explode(hides).alias("s")).select("expected", "s.*")
    sensitive = F.col("expected").isNotNull()
    out = rows.groupBy("strategy").agg(F.count_if(sensitive & F.col("hidden")).alias("tp"), F.count_if(sensitive).alias("labels"), F.count_if(F.col("hidden")).alias("hidden"), F.count_if(~sensitive & ~F.col("hidden")).alias("left"), F.count_if(~sensitive).alias("harmless"))
    return out.select("strategy", rate(F.col("tp"), F.col("labels")).alias("recall"), rate(F.col("tp"), F.col("hidden")).alias("precision"), rate(F.col("left"), F.col("harmless")).alias("context_kept"))


def layer_curve(layers: DataFrame) -> DataFrame:
    """(layer, ord, found, cost_ms) with running sums; the running cost is null from the first unknown cost on."""
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    unknown = F.max(F.col("cost_ms").isNull().cast("int")).over(upto)
    return layers.select("layer", "ord", F.sum("found").over(upto).alias("found"), F.when(unknown == 0, F.sum("cost_ms").over(upto)).alias("cost_ms"))


def area_scores(elements: DataFrame, truth: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Per page (or ``keys``): needed, painted and rightly painted area, and their rates. An element counts with its own box,
    whatever box was detected; one that is not among ``elements`` (page_id, element_id, position) has none."""
    keys = keys or ("page_id",)
    size = elements.groupBy("page_id", "element_id").agg(F.max(geom.area(F.col("position"))).alias("_area"))
    rows = compared(truth, found).join(size, ["page_id", "element_id"], "left").withColumn("_area", F.coalesce("_area", F.lit(0.0)))
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("_area"))), F.lit(0.0))
    wanted, painted = F.col("expected").isNotNull(), F.col("claimed").isNotNull()
    out = rows.groupBy(*keys).agg(total(wanted).alias("needed"), total(painted).alias("painted"), total(wanted & painted).alias("correct"))
    return out.select("*", rate(F.col("correct"), F.col("needed")).alias("coverage"), rate(F.col("correct"), F.col("painted")).alias("redaction_precision"), rate(F.col("painted"), F.col("needed"), 0.0).alias("area_ratio"))


def misses(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, missed, over_flagged): the labelled elements without a detection, and the detected ones without a label, sorted."""
    pairs = compared(truth, found)
    listed = lambda which: F.array_join(F.array_sort(F.collect_list(F.when(which, F.col("element_id")))), ",")
    return pairs.groupBy("page_id").agg(listed(F.col("claimed").isNull()).alias("missed"), listed(F.col("expected").isNull()).alias("over_flagged"))


def pixel_scores(truth: DataFrame, found: DataFrame, least: float = match.PIXEL_IOU) -> DataFrame:
    """Per page: labelled boxes (page_id, ord, category, position) matched one to one with detected ones by IoU; counts, areas and rates.

    Painted is the area of all detections, rightly painted the shared area of the matches.
    """
    near = match.overlapping(truth, found)
    iou = geom.iou(F.col("l.position"), F.col("r.position"))
    pairs = near.where(iou >= least).select("page_id", F.col("l.ord").alias("a"), F.col("r.ord").alias("b"), iou.alias("weight"), geom.intersection(F.col("l.position"), F.col("r.position")).alias("shared"), (F.col("l.category") == F.col("r.category")).alias("same"))
    matched = match.greedy_pairs(pairs).groupBy("page_id").agg(F.count(F.lit(1)).alias("true_positives"), F.sum("shared").alias("correct"), F.count_if("same").alias("right_category"))
    side = lambda df, n, a: df.groupBy("page_id").agg(F.count(F.lit(1)).alias(n), F.sum(geom.area(F.col("position"))).alias(a))
    rows = side(truth, "expected", "needed").join(side(found, "detected", "painted"), "page_id", "full").join(matched, "page_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("expected", "detected", "true_positives", "right_category")]
    none = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("needed", "painted", "correct")]
    out = rows.select("page_id", *zero, *none)
    tp = F.col("true_positives")
    return out.select("*", rate(tp, F.col("expected")).alias("recall"), rate(tp, F.col("detected")).alias("precision"), rate(F.col("correct"), F.col("needed")).alias("coverage"), rate(F.col("correct"), F.col("painted")).alias("redaction_precision"))
