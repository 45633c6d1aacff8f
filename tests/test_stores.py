import json
import math

from pyspark.sql import functions as F

from veilframe.functions.text import classify_text
from veilframe.operators import redact, replies, stores, vision

RECT = "struct<x:double,y:double,width:double,height:double>"


def test_texts_stay_and_frames_fit_the_budget(spark):
    rows = [("a", 1, 10, "t" * 100, "f" * 500), ("a", 2, 20, "é" * 50, "f" * 300), ("a", 3, 30, None, None), ("a", 4, 40, "t" * 100, "f" * 200), ("b", 1, 10, "t" * 5000, "f"), ("c", 1, 10, "x", "f" * 1536), ("c", 2, 10, "x", "g" * 1535), (None, 1, 1, "x", "y")]
    sent = spark.createDataFrame(rows, "device_id string, entry_id long, at long, json string, frame string")
    got = {(r.device_id, r.entry_id): (r.json is None or bool(r.json), r.frame is not None, r.frame_bytes, r.frame_note) for r in stores.kept_evidence(sent, budget=800, cap=3).collect()}
    assert set(got) == {("a", 2), ("a", 3), ("a", 4), ("b", 1), ("c", 1), ("c", 2), (None, 1)}
    assert got["a", 4][1] and got["a", 2][1] and got["a", 3][2] == 0  # 200 + 0 + 300 of frames and 200 of texts
    assert not got["b", 1][1] and got["b", 1][0]  # the text alone is beyond the budget: it stays
    assert got["c", 1][3] == "<redacted image, 2KB, omitted here for length>" and got["c", 2][3] == "<redacted image, 1KB, omitted here for length>"
    tight = {(r.device_id, r.entry_id): r.frame is not None for r in stores.kept_evidence(sent, budget=699, cap=3).collect()}
    assert tight["a", 4] and not tight["a", 2]
    latest = stores.kept_evidence(sent).collect()
    assert sorted((r.device_id or "", r.entry_id) for r in latest) == [("", 1), ("a", 4), ("b", 1), ("c", 2)]  # of equal times the larger id


def test_proofs_hold_painted_screens_of_the_newest_scan(spark):
    rows = [("a", 1, 10, s, True) for s in range(3)] + [("a", 2, 20, s, s != 1) for s in range(5)] + [("b", 7, 1, 0, False), ("c", 1, 5, 0, True), ("c", 2, 5, 0, True), ("d", 1, 1, 0, None)]
    screens = spark.createDataFrame(rows, "device_id string, proof_id long, at long, stop int, painted boolean")
    got = sorted((r.device_id, r.proof_id, r.stop, r.omitted) for r in stores.kept_proofs(screens, most=3).collect())
    assert got == [("a", 2, 0, 1), ("a", 2, 2, 1), ("a", 2, 3, 1), ("c", 2, 0, 0)]


def test_an_export_holds_its_fields_and_no_more(spark):
    rows = [("a", 1, 0, "run", True, 3, "secret"), ("a", 2, 1_700_000_000_123, "scan", False, None, "secret")]
    entries = spark.createDataFrame(rows, "device_id string, entry_id long, at long, kind string, transmitted boolean, total long, text string")
    [r] = stores.audit_json(entries, 0, ("kind", "transmitted", "total")).collect()
    assert json.loads(r.json) == {
        "generatedAt": "1970-01-01T00:00:00.000Z",
        "note": "categories, counts and times only",
        "entries": [{"at": "2023-11-14T22:13:20.123Z", "kind": "scan", "transmitted": False, "total": None}, {"at": "1970-01-01T00:00:00.000Z", "kind": "run", "transmitted": True, "total": 3}],
    }


def test_latency_is_exact_for_small_groups_and_near_for_large(spark):
    small = spark.createDataFrame([("a", float(k)) for k in (5, 1, 4, 2, 3)] + [("b", 7.0), ("b", None), ("c", None)], "stage string, ms double")
    got = {r.stage: (r.n, r.least, r.most, r.mean, r.q50, r.q95) for r in stores.latency(small, "stage").collect()}
    assert got == {"a": (5, 1.0, 5.0, 3.0, 3.0, 5.0), "b": (1, 7.0, 7.0, 7.0, 7.0, 7.0)}
    large = spark.range(200_000, numPartitions=9).select(F.lit("s").alias("stage"), (F.col("id") * 7919 % 200_000).alias("ms"))
    [r] = stores.latency(large, "stage", accuracy=1000).collect()
    assert abs(r.q50 - 100_000) <= 200 and abs(r.q95 - 190_000) <= 200


def test_latencies_are_exact_where_the_sketch_is_not(spark):
    big = spark.range(30_000).select(F.lit("a").alias("stage"), (F.col("id") * 7919 % 10007).alias("ms"))
    hot = spark.range(30_000).select(F.lit(None).cast("string").alias("stage"), F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("ms"))
    got = {r.stage: (r.n, r.least, r.most, r.q50, r.q95) for r in stores.latency(big.union(hot), "stage", accuracy=50).collect()}
    at = lambda v, q: sorted(v)[math.ceil(len(v) * q) - 1]
    a, b = [k * 7919 % 10007 for k in range(30_000)], [5 if k % 3 else k for k in range(30_000)]
    assert got == {"a": (30_000, min(a), max(a), at(a, 0.5), at(a, 0.95)), None: (30_000, min(b), max(b), at(b, 0.5), at(b, 0.95))}
    [whole] = stores.latency(big, accuracy=50).collect()
    assert (whole.q50, whole.q95) == (at(a, 0.5), at(a, 0.95))


def test_responses_of_the_server(spark):
    ok = {"request_id": "r", "status": "action_ready", "action": {"type": "scroll", "selector": "e1"}}
    bodies = [ok, ok | {"action": {"type": "type", "selector": "e1", "value": "v"}, "reasoning_summary": "s"}, {"status": "needs_more_context"}, {"status": "error", "error_code": "INTERNAL_ERROR"}, {"status": "error"}, {}, ok | {"action": None}, ok | {"action": {"type": "open", "selector": "e"}}, ok | {"action": {"type": "click", "selector": 5}}, "x", None, "null", "[]"]
    df = spark.createDataFrame([(k, b if b is None or isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "k long, value string")
    got = replies.responses(df).orderBy("k").collect()
    assert [r.refused for r in got] == [None, None, None, "error INTERNAL_ERROR", "error of no known code", "unknown status", "no action", "action not allowed", "no selector", "not JSON", "not JSON", "not an object", "unknown status"]
    assert (got[0].outcome, got[0].action, got[0].typed, got[0].request_id) == ("action", "scroll", None, "r") and (got[1].typed, got[1].summary) == ("v", "s") and got[2].outcome == "needs_more_context" and got[9].request_id == ""


def test_detections_of_whole_pictures(spark):
    words = spark.createDataFrame([(1, 0, "mail", (10.0, 10.0, 40.0, 20.0)), (1, 1, "me@mail.example", (60.0, 10.0, 90.0, 20.0)), (2, 0, "Passport", (0.0, 0.0, 50.0, 10.0)), (3, 0, "nothing", (0.0, 0.0, 50.0, 10.0))], f"page_id long, ord long, text string, position {RECT}")
    frames = spark.createDataFrame([(k, 300, 200) for k in (1, 2, 3)], "page_id long, width int, height int")
    got = {r.page_id: (r.category, tuple(r.position), r.element_id) for r in vision.pixel_detections(words, frames, classify_text).collect()}
    assert got == {1: ("email", (5.0, 5.0, 150.0, 30.0), None), 2: ("id_number", (0.0, 0.0, 300.0, 200.0), None)}


def test_values_that_a_payload_still_holds():
    import time

    payload = json.dumps({"a": 'say "hi"\tAda', "text": "Lovelace\\x", "é": "naïve"}, ensure_ascii=False)
    assert redact.held_values(payload, ['say "hi"\tAda', "Ada", "lace", "text", "Love", "x1", "naïve", "acelove"]) == sorted(['say "hi"\tAda', "Ada", "lace", "text", "Love", "naïve"])
    assert redact.held_values("", ["abcd"]) == [] and redact.held_values("abcd", []) == []
    start = time.process_time()
    many = [f"value-{k}-" for k in range(20_000)]
    assert redact.held_values(" ".join(many[::2]) * 3, many) == sorted(many[::2])
    assert time.process_time() - start < 20
