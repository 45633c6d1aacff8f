"""What goes to and comes back from the party that decides: page contexts, typed values, changed targets; notes of runs.

Rows with null keys join nothing. Empty tables give empty results; extra columns pass through where a function says
that it returns its input with more columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.decide import CREDENTIAL_REFERENCE
from veilframe.operators.replies import truncated

#: Tags and input types that still are what an action expects.
TYPED_INTO, PRESSED, PRESSING_INPUTS = ("input", "textarea", "select"), ("button", "a"), ("submit", "button")


def in_view(position: Column, width: Column, height: Column) -> Column:
    """Whether a box with an area shares some of it with a viewport of ``width`` by ``height``; null boxes do not."""
    x, y, w, h = (position[n] for n in ("x", "y", "width", "height"))
    return F.coalesce((w > 0) & (h > 0) & (x < width) & (y < height) & (x + w > 0) & (y + h > 0), F.lit(False))


def rendered(visibility: Column, display: Column, opacity: Column) -> Column:
    """Whether a style lets an element be seen; a style that is not stated hides nothing."""
    return F.coalesce(visibility != "hidden", F.lit(True)) & F.coalesce(display != "none", F.lit(True)) & F.coalesce(opacity != 0, F.lit(True))


def described() -> Column:
    """One element as JSON: what a decision needs, no position; the row only where there is one."""
    shown = [F.col("element_id").alias("elementId"), F.col("element_type").alias("type"), truncated(F.col("label")).alias("label"), truncated(F.col("value")).alias("value"), F.col("filled").alias("filled")]
    whole = {"ignoreNullFields": "false"}
    return F.when(F.col("row").isNull(), F.to_json(F.struct(*shown), whole)).otherwise(F.to_json(F.struct(*shown, F.col("row")), whole))


def contexts(elements: DataFrame, manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, hidden, elements, n_elements): the JSON context of each page, and the categories that were hidden on it.

    Elements stand in the order of ``ord``, ties by their JSON. A page's context is one value; the element budget
    (``redact.budgeted``) bounds it beforehand.
    """
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_j"))), lambda e: e["_j"]), ", ")
    pages = elements.select(key, "ord", described().alias("_j")).groupBy(key).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("elements"), F.count(F.lit(1)).alias("n_elements"))
    hidden = manifest.where("category is not null").select(key, "category").distinct().groupBy(key).agg(F.to_json(F.array_sort(F.collect_list("category"))).alias("_h"))
    return pages.join(hidden, key, "left").select(key, F.coalesce("_h", F.lit("[]")).alias("hidden"), "elements", "n_elements")


def typed_values(actions: DataFrame, regions: DataFrame, key: str = "page_id") -> DataFrame:
    """``actions`` (page_id, action, selector, value) with ``typed``, the text that may be typed, and ``withheld``, why none.

    A reference to a saved credential is never resolved, and no literal goes into an element that has a region
    (page_id, element_id). Actions that type nothing have neither.
    """
    covered = regions.where("element_id is not null").select(F.col(key).alias("_k"), F.col("element_id").alias("_e")).distinct()
    met = actions.join(covered, (F.col(key) == F.col("_k")) & (F.col("selector") == F.col("_e")), "left")
    types = F.coalesce(F.col("action") == "type", F.lit(False))
    why = F.when(types & F.coalesce(F.col("value") == CREDENTIAL_REFERENCE, F.lit(False)), "no saved credential").when(types & F.col("_e").isNotNull(), "literal for a hidden field")
    return met.withColumn("withheld", why).withColumn("typed", F.when(types & F.col("withheld").isNull(), F.col("value"))).drop("_k", "_e")


def still_fits(expected: Column, tag: Column, role: Column, input_type: Column) -> Column:
    """Whether an element of this tag, role and input type still is of the expected kind; other kinds are not compared."""
    pressed = tag.isin(*PRESSED) | F.coalesce(role == "button", F.lit(False)) | ((tag == "input") & F.coalesce(input_type.isin(*PRESSING_INPUTS), F.lit(False)))
    return F.when(expected == "input", tag.isin(*TYPED_INTO)).when(expected == "button", pressed).otherwise(F.lit(True))


def rechecked(targets: DataFrame, now: DataFrame, key: str = "page_id") -> DataFrame:
    """``targets`` (page_id, element_id, element_type, label) with ``change``: how the later capture differs, null if it doesn't.

    ``now`` (page_id, element_id, tag, role, input_type, visible, label) has one row for each element. Labels count only where
    one was captured.
    """
    later = now.select(F.col(key).alias("_k"), F.col("element_id").alias("_e"), F.col("tag").alias("_tag"), F.col("role").alias("_role"), F.col("input_type").alias("_it"), F.col("visible").alias("_v"), F.col("label").alias("_l"))
    met = targets.join(later, (F.col(key) == F.col("_k")) & (F.col("element_id") == F.col("_e")), "left")
    change = (
        F.when(F.col("_e").isNull(), "gone")
        .when(~F.coalesce("_v", F.lit(False)), "not visible")
        .when(~F.coalesce(still_fits(F.col("element_type"), F.col("_tag"), F.col("_role"), F.col("_it")), F.lit(False)), "another kind")
        .when(F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("_l")), "another label")
    )
    return met.withColumn("change", change).drop("_k", "_e", "_tag", "_role", "_it", "_v", "_l")


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, one).otherwise(many))


def proof_notes(screens: DataFrame, scans: DataFrame, key: str = "scan_id") -> DataFrame:
    """(scan_id, screens, covered, note) of each scan (scan_id, truncated, omitted), from its screens (scan_id, covered)."""
    sums = screens.groupBy(key).agg(F.count(F.lit(1)).alias("screens"), F.sum("covered").alias("covered"))
    rows = scans.join(sums, key, "left").withColumns({"screens": F.coalesce("screens", F.lit(0).cast("long")), "covered": F.coalesce("covered", F.lit(0).cast("long"))})
    hidden = F.when(F.col("covered") == 0, "nothing found").otherwise(_counted(F.col("covered"), " area covered", " areas covered"))
    gaps = F.array_compact(F.array(F.when(F.col("truncated"), "ended before the bottom"), F.when(F.col("omitted") > 0, _counted(F.col("omitted"), " screen not shown", " screens not shown"))))
    note = F.concat_ws("; ", F.concat(_counted(F.col("screens"), " screen examined, ", " screens examined, "), hidden), gaps)
    return rows.select(key, "screens", "covered", note.alias("note"))


#: Bytes of the unit in which memory is told.
MEGABYTE = 1 << 20


def memory_deltas(samples: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, before_mb, after_mb, delta_mb): heap at the first and last sample (run, at, ord, used) of a run.

    A sample that was not measured is null, not zero, and so is a difference to it.
    """
    at = F.struct("at", "ord")
    ends = samples.groupBy(run).agg(F.min_by(F.struct("used"), at).alias("_a"), F.max_by(F.struct("used"), at).alias("_b"))
    return ends.select(run, (F.col("_a.used") / MEGABYTE).alias("before_mb"), (F.col("_b.used") / MEGABYTE).alias("after_mb"), ((F.col("_b.used") - F.col("_a.used")) / MEGABYTE).alias("delta_mb"))
