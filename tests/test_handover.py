import json

from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.operators import coverage, handover

ELEMENTS = "page_id long, ord long, element_id string, element_type string, label string, value string, filled boolean, row long"


def test_contexts_stay_one_json_value(spark):
    odd = 'a "label"\n# SECTION \\ é'
    rows = [(1, 2, "e2", "input", odd, None, True, None), (1, 1, "e1", "text", None, "x" * 500, False, 4), (1, 2, "e2", "input", odd, None, True, None), (2, 1, None, None, None, None, None, None)]
    manifest = spark.createDataFrame([(1, "name"), (1, "email"), (1, "name"), (1, None), (3, "card")], "page_id long, category string")
    elements = spark.createDataFrame(rows, ELEMENTS)
    got = {r.page_id: r for r in handover.contexts(elements, manifest).collect()}
    assert json.loads(got[1].hidden) == ["email", "name"] and got[2].hidden == "[]" and set(got) == {1, 2}
    told = json.loads(got[1].elements)
    assert "\n" not in got[1].elements and [e["elementId"] for e in told] == ["e1", "e2", "e2"] and got[1].n_elements == 3
    assert told[1]["label"] == odd and told[1]["value"] is None and "row" not in told[1] and told[0]["row"] == 4
    assert told[0]["value"].endswith("...(truncated)") and len(told[0]["value"]) < 300
    assert handover.contexts(elements.limit(0), manifest).count() == 0


def test_typed_values(spark):
    actions = [(1, "type", "e1", "someone"), (1, "type", "e2", "someone"), (1, "type", "e1", "[USE_SAVED_CREDENTIAL]"), (1, "click", "e1", "someone"), (None, "type", "e1", "x"), (1, "type", None, None), (1, None, "e1", "x")]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(actions)], "n int, page_id long, action string, selector string, value string")
    regions = spark.createDataFrame([(1, "e1"), (1, "e1"), (1, None), (2, "e2")], "page_id long, element_id string")
    got = {r.n: (r.typed, r.withheld) for r in handover.typed_values(df, regions).collect()}
    assert len(got) == len(actions) == handover.typed_values(df, regions).count()
    assert got == {0: (None, "literal for a hidden field"), 1: ("someone", None), 2: (None, "no saved credential"), 3: (None, None), 4: ("x", None), 5: (None, None), 6: (None, None)}


def test_changed_targets(spark):
    kinds = [("input", "select", None, None, None), ("input", "button", None, None, "another kind"), ("button", "a", None, None, None), ("button", "div", "button", None, None), ("button", "input", None, "submit", None), ("button", "input", None, "text", "another kind"), ("image", "div", None, None, None), ("input", None, None, None, "another kind")]
    targets = [(1, f"k{i}", k[0], "L") for i, k in enumerate(kinds)] + [(1, "lost", "input", "L"), (1, "unseen", "input", "L"), (1, "named", "input", "L"), (1, "plain", "input", None), (None, "k0", "input", "L"), (1, "unlabelled", "input", "L")]
    now = [(1, f"k{i}", k[1], k[2], k[3], True, "L") for i, k in enumerate(kinds)] + [(1, "unseen", "input", None, None, False, "L"), (1, "named", "input", None, None, True, "M"), (1, "plain", "input", None, None, True, "M"), (1, "unlabelled", "input", None, None, True, None)]
    t = spark.createDataFrame(targets, "page_id long, element_id string, element_type string, label string")
    n = spark.createDataFrame(now, "page_id long, element_id string, tag string, role string, input_type string, visible boolean, label string")
    got = {(r.page_id, r.element_id): r.change for r in handover.rechecked(t, n).collect()}
    want = {(1, f"k{i}"): k[4] for i, k in enumerate(kinds)} | {(1, "lost"): "gone", (1, "unseen"): "not visible", (1, "named"): "another label", (1, "plain"): None, (None, "k0"): "gone", (1, "unlabelled"): "another label"}
    assert got == want


def test_views_and_styles(spark):
    boxes = [(0, 0, 10, 10), (-10, 0, 10, 10), (-9, 0, 10, 10), (99, 49, 1, 1), (100, 0, 5, 5), (0, 50, 5, 5), (5, 5, 0, 5)]
    df = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "x double, y double, w double, h double").select(geom.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("p"))
    shown = [r[0] for r in df.select(handover.in_view(F.col("p"), F.lit(100), F.lit(50))).collect()]
    assert shown == [True, False, True, True, False, False, False]
    styles = spark.createDataFrame([(None, None, None), ("visible", "block", 0.5), ("hidden", None, None), (None, "none", None), (None, None, 0.0)], "v string, d string, o double")
    assert [r[0] for r in styles.select(handover.rendered(F.col("v"), F.col("d"), F.col("o"))).collect()] == [True, True, False, False, False]


def test_notes_and_memory(spark):
    screens = spark.createDataFrame([(1, 0), (2, 1), (2, None)], "scan_id long, covered long")
    scans = spark.createDataFrame([(1, False, 0), (2, True, 2), (3, None, None)], "scan_id long, truncated boolean, omitted long")
    notes = {r.scan_id: (r.screens, r.covered, r.note) for r in handover.proof_notes(screens, scans).collect()}
    assert notes == {1: (1, 0, "1 screen examined, nothing found"), 2: (2, 1, "2 screens examined, 1 area covered; ended before the bottom; 2 screens not shown"), 3: (0, 0, "0 screens examined, nothing found")}
    samples = spark.createDataFrame([(1, 5, 0, 3 << 20), (1, 1, 0, 1 << 20), (2, 1, 0, None), (2, 2, 0, 1 << 20), (3, 1, 0, 0)], "run_id long, at long, ord long, used long")
    deltas = {r.run_id: (r.before_mb, r.after_mb, r.delta_mb) for r in handover.memory_deltas(samples).collect()}
    assert deltas == {1: (1.0, 3.0, 2.0), 2: (None, 1.0, None), 3: (0.0, 0.0, 0.0)}


def test_floor_costs_without_images(spark):
    none = spark.createDataFrame([], "position struct<x:double,y:double,width:double,height:double>, sensitive boolean")
    rows = coverage.floor_costs(none).collect()
    assert [r.floor for r in rows] == list(coverage.SWEEP)
    assert all((r.crops, r.caught, r.recall, r.precision, r.relative_cost) == (0, 0, 1.0, 1.0, 1.0) for r in rows)
