"""Guards over runs of steps: repeated actions, stages out of order, consent, the end of a task, verdicts.

Runs are short and a window or a fold over one run's steps decides; runs are spread by their key. Ties in
the order of steps are ordered by the tie column. Null signatures never repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import geom

# Fixed values.
STAGES = ("reading", "detecting", "redacting", "sending", "thinking", "acting")
CONSENT_MS, MOST_STEPS, SPARE_STEPS, FOLD_PX = 60_000, 5, 3, 24


def signature(action: Column, element: Column, value: Column) -> Column:
    """The identity of an action."""
    return F.concat_ws("|", action, F.coalesce(element, F.lit("")), F.coalesce(value, F.lit("")))


def repeated(steps: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """``steps`` (run, step, signature) with ``repeats``: whether the step before it was the same."""
    before = F.lag("signature").over(Window.partitionBy(run).orderBy(step))
    return steps.withColumn("repeats", F.coalesce(before == F.col("signature"), F.lit(False)))


def taken_steps(steps: DataFrame, most: int = MOST_STEPS, run: str = "run_id", step: str = "step") -> DataFrame:
    """The steps (run, step, signature, final) that a task takes, with ``stop`` on its last one: it ends after a final
    action, before a repeated one, and at ``most`` steps."""
    order = Window.partitionBy(run).orderBy(step)
    rows = repeated(steps, run, step).withColumn("_n", F.row_number().over(order))
    past = F.coalesce(F.max(F.col("final").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    shut = F.max(F.col("repeats").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    kept = rows.where(F.col("_n") <= most + 1).select("*", (past | shut | (F.col("_n") > most)).alias("_out"))
    following = F.lead("_out").over(order)
    why = F.when(F.col("final"), "final").when(F.lead("repeats").over(order), "repeat").when(F.col("_n") == most, "most steps").when(following.isNull(), "done")
    return kept.withColumn("stop", F.when(F.coalesce(following, F.lit(True)), why)).where("not _out").drop("_n", "_out", "repeats")


def in_order(done: Column, stage: Column, stages: Sequence[str] = STAGES) -> Column:
    """Whether all stages before ``stage`` are among ``done``."""
    every = F.array(*map(F.lit, stages))
    before = F.slice(every, F.lit(1), F.greatest(F.lit(0), F.array_position(every, stage).cast("int") - 1))
    return F.forall(before, lambda s: F.array_contains(done, s)) & (F.array_position(every, stage) > 0)


def consents(requests: DataFrame, decisions: DataFrame, limit_ms: int = CONSENT_MS, device: str = "device_id") -> DataFrame:
    """``requests`` (device_id, request_id, at) with ``outcome``: of one device one request is pending at a time.

    A newer request makes an older one stale, a decision (device_id, request_id, at, approved) in time settles it, else
    it times out. Only approved ones may be sent. Of several decisions the first counts.
    """
    newer = F.lead("at").over(Window.partitionBy(device).orderBy("at", "request_id"))
    first = decisions.groupBy(device, "request_id").agg(F.min(F.struct("at", "approved")).alias("_d"))
    rows = requests.withColumn("_newer", newer).join(first, [device, "request_id"], "left")
    until = F.least(F.col("at") + limit_ms, F.coalesce("_newer", F.col("at") + limit_ms))
    timely = F.col("_d.at").between(F.col("at"), until)
    other = F.when(F.coalesce(F.col("_newer") <= F.col("at") + limit_ms, F.lit(False)), "stale").otherwise("timed-out")
    outcome = F.when(F.coalesce(timely, F.lit(False)), F.when(F.col("_d.approved"), "approved").otherwise("declined")).otherwise(other)
    return rows.withColumn("outcome", outcome).withColumn("may_send", F.col("outcome") == "approved").drop("_newer", "_d")


def verdicts(steps: DataFrame, spare: int = SPARE_STEPS, run: str = "run_id") -> DataFrame:
    """(run, right, wrong, passed) of steps (run, step, matches: the number of the expectation that the step's action
    meets, expected: how many there are). A run passes if it meets all in order within ``spare`` more steps."""
    listed = steps.groupBy(run).agg(F.max("expected").alias("expected"), F.array_sort(F.collect_list(F.struct("step", "matches"))).alias("_s"))
    allowed = F.slice("_s", F.lit(1), F.col("expected") + spare)
    met = F.aggregate(allowed, F.lit(0), lambda acc, s: F.when((acc < F.col("expected")) & (s["matches"] == acc + 1), acc + 1).otherwise(acc))
    return listed.select(run, met.alias("met"), (F.least(F.size("_s"), F.col("expected") + spare) - met).alias("wrong"), (met == F.col("expected")).alias("passed"))


def coverage_note(document: Column, view: Column, outside: Column) -> Column:
    """STRUCT<partial, screens, message>: how much of a page one look at it covers."""
    height = F.greatest(view, F.lit(1)).cast("double")
    partial = document > height + FOLD_PX
    screens = F.greatest(F.lit(1.0), document / height)
    more = F.when(outside > 0, F.concat(F.lit("; outside it are "), outside.cast("string"), F.when(outside == 1, " element").otherwise(" elements"))).otherwise("")
    text = F.when(partial, F.concat(F.lit("about "), F.format_string("%.1f", F.floor(screens * 10 + 0.5) / 10), F.lit(" screens, one of them examined"), more)).otherwise("all of the page examined")
    return F.struct(partial.alias("partial"), F.when(partial, screens).otherwise(1.0).alias("screens"), text.alias("message"))


def marked_regions(marks: DataFrame, elements: DataFrame, key: str = "page_id", source: str = "manual", reason: str = "marked by hand") -> DataFrame:
    """Regions of marks (page_id, mark_id, category, position): one of each mark and one of each element that shares an area with it."""
    own = marks.select(key, "mark_id", F.lit(None).cast("string").alias("element_id"), "category", "position")
    e = elements.select(F.col(key).alias("_k"), F.col("element_id").alias("element_id"), F.col("position").alias("_p"))
    met = marks.join(e, (F.col(key) == F.col("_k")) & geom.overlaps(F.col("position"), F.col("_p")))
    both = own.unionByName(met.select(key, "mark_id", "element_id", "category", F.col("_p").alias("position")))
    return both.withColumns({"source": F.lit(source), "confidence": F.lit(1.0), "reason": F.lit(reason)})


#: The order in which regions of different sources follow each other.
SOURCE_ORDER = ("dom", "visual", "ocr", "remembered", "manual")


def concatenated(regions: DataFrame, key: str = "page_id") -> DataFrame:
    """``regions`` with ``place``, their number in the page: by source as listed, then by ``ord``."""
    rank = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source"))
    return regions.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, "ord")))
