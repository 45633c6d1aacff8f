"""Literal cases of the operators that the supplied tables don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.operators import coverage, decide, fleet, guards, match, replies, vision
from veilframe.sources import captured
from veilframe.streaming import fleet as stream

BOX = "struct<x:double,y:double,width:double,height:double>"


def box(x, y, w, h):
    return (float(x), float(y), float(w), float(h))


def report(**changes):
    entry = {"at": 5, "kind": "run", "examined": "viewport", "transmitted": True, "counts": [{"category": "email", "count": 2}], "total": 2, "durationMs": None}
    return {"device_id": "abc-12345", "device_name": "One", "team": "T", "entries": [entry | changes.pop("entry", {})]} | changes


def test_fleet_reports_are_refused_whole(spark):
    cases = {
        "ok": (report(), None),
        "no entries": (report(entries=[]), None),
        "other name": ({"deviceId" if k == "device_id" else k: v for k, v in report().items()}, "unknown field"),
        "url": (report(url="x"), "unknown field"),
        "entry url": (report(entry={"url": "x"}), "unknown field"),
        "count rule": (report(entry={"counts": [{"category": "email", "count": 1, "rule": "r"}]}), "unknown field"),
        "early": (report(entry={"at": -5}), "value out of bounds"),
        "short time": (report(entry={"durationMs": -1}), "value out of bounds"),
        "category": (report(entry={"counts": [{"category": "salary", "count": 1}]}), "value out of bounds"),
        "many": (report(entry={"counts": [{"category": "email", "count": 100_001}]}), "value out of bounds"),
        "seventeen": (report(entry={"counts": [{"category": "email", "count": 1}] * 17}), "value out of bounds"),
        "short id": (report(device_id="abc"), "value out of bounds"),
        "id": (report(device_id="abc 12345"), "value out of bounds"),
        "no team": (report(team=""), "value out of bounds"),
        "long name": (report(device_name="n" * 41), "value out of bounds"),
        "201": (report(entries=report()["entries"] * 201), "value out of bounds"),
    }
    df = spark.createDataFrame([(n, json.dumps(r)) for n, (r, _) in cases.items()] + [("text", "nothing"), ("null", None)], "name string, value string")
    got = {r.name: r.refused for r in fleet.validated(df).collect()}
    assert got == {n: why for n, (_, why) in cases.items()} | {"text": "not an object", "null": "not an object"}


def test_upsert_stream_survives_a_replay(spark, tmp_path):
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    schema = "device_id string, seen long, report_id long, total long"
    spark.createDataFrame([("a", 1, 1, 5), ("b", 1, 2, 6), ("a", 2, 3, 7)], schema).write.json(source)
    run = lambda n: stream.upsert_stream(spark.readStream.schema(schema).json(source), store, str(tmp_path / f"check{n}")).awaitTermination()
    run(1)
    rows = lambda: sorted((r.device_id, r.total) for r in stream.current(spark, store).collect())
    assert rows() == [("a", 7), ("b", 6)]
    spark.createDataFrame([("b", 9, 4, 1), ("c", 1, 5, 2)], schema).write.mode("append").json(source)
    run(1)
    assert rows() == [("a", 7), ("b", 1), ("c", 2)]
    run(2)  # the whole input again, as after a lost checkpoint
    assert rows() == [("a", 7), ("b", 1), ("c", 2)]


def test_reports_are_cut_and_named(spark):
    rows = [("d", "n" * 50, "", i, i % 7, "run", "viewport", True, [("email", 1)], 1, None) for i in range(9)]
    df = spark.createDataFrame(rows, "device_id string, device_name string, team string, entry_id long, at long, kind string, examined string, transmitted boolean, counts array<struct<category:string,count:long>>, total long, duration_ms double")
    made = json.loads(fleet.report_of(df, 3).first().report)
    assert made["device_name"] == "n" * 40 and made["team"] == "Unassigned" and [e["at"] for e in made["entries"]] == [4, 5, 6]
    assert set(made["entries"][0]) == {"at", "kind", "examined", "transmitted", "counts", "total", "durationMs"}


def entries(spark, rows):
    return spark.createDataFrame([(1, i, f"e{i}", t, v, label, filled, None, box(0, y, 10, 10)) for i, (t, v, label, filled, y) in enumerate(rows)], f"page_id long, ord int, element_id string, element_type string, value string, label string, filled boolean, row int, position {BOX}")


PASSWORD, EMAIL = ("input", "[PASSWORD]", None, True, 30), ("input", "[EMAIL]", None, True, 10)


@pytest.mark.parametrize(
    ("rows", "form", "action", "element"),
    [
        ([EMAIL, ("input", "[PASSWORD]", None, False, 30)], "login", "type", "e1"),
        ([("button", None, "Sign in", True, 0), EMAIL, PASSWORD, ("button", None, "LOG IN", True, 50), ("button", None, "Sign up", True, 45)], "login", "click", "e3"),
        ([EMAIL, PASSWORD, ("button", None, "Next", True, 32)], "login", "click", "e2"),
        ([EMAIL, PASSWORD], "login", None, None),
        ([EMAIL, PASSWORD, PASSWORD, ("text", "low", None, True, 90)], "signup", "scroll", "e3"),
        ([EMAIL, PASSWORD, ("input", "[PASSWORD]", None, False, 40)], "signup", None, None),
        ([EMAIL, PASSWORD, PASSWORD, ("input", "[PASSWORD]", None, False, 40), ("button", None, "Register", True, 60)], "signup", "click", "e4"),
        ([EMAIL, PASSWORD, PASSWORD, ("input", "unchecked", "I agree to marketing", False, 50), ("input", "unchecked", "Accept the terms", False, 55), ("button", None, "Join now", True, 60)], "signup", "click", "e4"),
        ([EMAIL, PASSWORD, PASSWORD, ("input", "checked", "Accept the terms", True, 55), ("button", None, "Join now", True, 60)], "signup", "click", "e4"),
        ([EMAIL, ("input", "[NAME]", None, False, 12), ("input", "[PHONE]", None, False, 14), PASSWORD, ("button", None, "Submit", True, 60)], "signup", "click", "e4"),
        ([("text", "hello", None, True, 0)], None, None, None),
    ],
)
def test_decisions(spark, rows, form, action, element):
    got = decide.decisions(entries(spark, rows)).first()
    assert (got.form, got.action, got.element_id) == (form, action, element)
    assert ("2 personal fields" in got.note) == (len(rows) == 5 and rows[2][1] == "[PHONE]")


def test_replies_with_odd_bodies(spark):
    page = entries(spark, [("text", "Fee paid", "Status", True, 0), ("button", None, "Release", True, 5)])
    bodies = [None, "", "[1]", '{"status": 1}', '{"status": "action_ready", "action": {"type": "click", "selector": "e1"}, "confidence": "high"}', '{"status":"action_ready","action":{"type":"type","selector":"e0","value":"[X]"}}', "<THINK>a</THINK>{\"status\":\"needs_more_context\"}", "{broken"]
    df = spark.createDataFrame([(i, 1, "task", b) for i, b in enumerate(bodies)], "reply_id int, page_id long, task string, reply string")
    got = {r.reply_id: (r.refused, r.action, r.confidence) for r in replies.interpreted(df, page).collect()}
    assert got[0][0] == got[1][0] == got[2][0] == "no object" and got[3][0] == "no recognised status" and got[7][0] == "no object"
    assert got[4] == (None, "click", 0.5) and got[5][0] == "placeholder typed" and got[6] == (None, None, 0.0)


def test_lines_and_empty_tables(spark):
    kind = f"page_id long, ord int, text string, position {BOX}"
    rows = [(1, 0, "b", box(50, 10, 10, 10)), (1, 1, "a", box(0, 12, 10, 10)), (1, 2, "c", box(0, 40, 10, 10)), (1, 3, None, box(90, 41, 5, 5))]
    got = {r.line: (r.text, r.words) for r in vision.line_boxes(spark.createDataFrame(rows, kind), "page_id").collect()}
    assert got == {1: ("a b", 2), 2: ("c", 2)}
    none = spark.createDataFrame([], kind)
    assert vision.line_boxes(none, "page_id").count() == vision.screen_lines(none, geom.rect(0, 0, 1, 1), geom.rect(0, 0, 1, 1)).count() == 0
    assert vision.priors(spark).count() == 4420


def test_looks_merge(spark):
    rows = [(1, 0, False, box(0, 0, 100, 100)), (1, 1, True, box(0, 5, 100, 100)), (1, 2, False, box(300, 0, 50, 50))]
    images = spark.createDataFrame(rows, f"page_id long, ord long, seen_whole boolean, position {BOX}")
    none = spark.createDataFrame([], f"page_id long, source string, position {BOX}")
    assert [r.ord for r in coverage.unexamined(images, none).collect()] == [2]


def test_folds_with_ties_and_repeats(spark):
    rows = [(1, 0, 0.5, box(0, 0, 10, 10)), (1, 1, 0.5, box(0, 0, 10, 10)), (1, 2, 0.9, box(4, 0, 10, 10)), (2, 0, 0.2, box(0, 0, 1, 1))]
    boxes = spark.createDataFrame(rows, f"page_id long, ord int, score double, position {BOX}")
    assert [(r.page_id, r.ord) for r in match.suppressed(boxes).collect()] == [(1, 2)]
    assert match.suppressed(boxes.limit(0)).count() == 0


def test_consents_and_order(spark):
    asked = spark.createDataFrame([("d", 1, 0), ("d", 2, 10_000), ("d", 3, 200_000)], "device_id string, request_id long, at long")
    said = spark.createDataFrame([("d", 1, 20_000, True), ("d", 2, 15_000, True), ("d", 2, 16_000, False)], "device_id string, request_id long, at long, approved boolean")
    got = {r.request_id: (r.outcome, r.may_send) for r in guards.consents(asked, said).collect()}
    assert got == {1: ("stale", False), 2: ("approved", True), 3: ("timed-out", False)}
    df = spark.createDataFrame([(["reading", "detecting", "redacting"], "sending"), (["reading", "redacting"], "sending"), ([], "reading"), (["reading"], "odd")], "done array<string>, stage string")
    assert [r.ok for r in df.select(guards.in_order(F.col("done"), F.col("stage")).alias("ok")).collect()] == [True, False, True, False]


def test_captured_maps(spark, tmp_path):
    good = {"about": "a", "elements": [{"elementId": "e0", "elementType": "text", "value": " x ", "url": "no", "position": {"x": 1, "y": 2, "width": 3, "height": 4}}], "sensitive": [{"elementId": "e0", "category": "name"}]}
    for name, body in {"good": good, "bare": {"elements": []}, "unlabelled": {"elements": good["elements"]}, "elsewhere": good | {"sensitive": [{"elementId": "e9", "category": "name"}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "broken.json").write_text("{")
    maps = captured.read(spark, str(tmp_path))
    assert {r.id: r.refused for r in maps.collect()} == {"good": None, "bare": "has no elements", "unlabelled": "has no labels", "elsewhere": "labels e9, not on the page", "broken": "could not be parsed"}
    rows = captured.elements_of(maps)
    assert [(r.field, r.value) for r in captured.reviewable(rows).collect()] == [("text", "x")]
    out = json.loads(captured.exported(rows, "again").first().json)
    assert "url" not in out["elements"][0] and out["elements"][0]["position"]["width"] == 3
    boxes = rows.select("page_id", F.lit("face").alias("category"), "position")
    assert captured.with_pixels(maps, boxes).where("pixels is not null").count() == 1
    assert captured.unmeasured(boxes, boxes.limit(0)).count() == 1
