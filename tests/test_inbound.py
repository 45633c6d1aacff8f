import json

from pyspark.sql import functions as F

from veilframe.functions import jsons
from veilframe.functions.jsons import Flag, Many, Number, Shape, Text
from veilframe.operators import fleet, replies, requests

RECT = {"x": 1, "y": 2, "width": 3, "height": 4}
GOOD = {"request_id": "r1", "task_query": "pay", "redacted_frame": "f", "redacted_dom_summary": [{"elementId": "e0", "elementType": "input", "position": RECT}], "redaction_manifest": [{"regionId": "a", "category": "email", "method": "ocr"}]}


def found(spark, *bodies, shape=requests.REQUEST):
    rows = [(k, b if b is None or isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)]
    judged = requests.validated(spark.createDataFrame(rows, "k long, value string"), shape).orderBy("k").collect()
    return [[(f.path, f.fault) for f in r.faults] for r in judged], [r.body for r in judged]


def changed(**parts):
    return GOOD | parts


def test_bodies_and_their_faults(spark):
    entry = GOOD["redacted_dom_summary"][0]
    faults, bodies = found(
        spark,
        GOOD,
        changed(task_query="x" * 500, other=[1]),
        changed(task_query="x" * 501),
        changed(task_query="🙂" * 500),
        changed(request_id=None, redaction_manifest=None),
        {},
        [GOOD],
        json.dumps(GOOD) + " trailing",
        None,
        "",
        "5",
        changed(redacted_dom_summary=[entry | {"row": 1}, entry | {"row": 10_000}, entry | {"row": "7"}, entry | {"row": 3.0}, entry | {"row": True}, entry | {"filled": "YES"}, entry | {"filled": 0.0}]),
        changed(redacted_dom_summary=[entry | {"row": 10_001}, entry | {"row": -1}, entry | {"row": "x"}, entry | {"row": 1.5}, entry | {"row": []}, entry | {"filled": 2}, entry | {"position": RECT | {"x": "1e3", "y": " .5 "}}]),
        changed(redacted_dom_summary=[]),
    )
    assert faults[0] == faults[1] == faults[3] == faults[11] == faults[13] == []
    assert faults[2] == [("task_query", "longer than 500")]
    assert faults[4] == [("request_id", "not a text"), ("redaction_manifest", "not a list")]
    assert faults[5] == [(n, "missing") for n in ("request_id", "task_query", "redacted_frame", "redacted_dom_summary", "redaction_manifest")]
    assert faults[6] == [("", "not an object")] == faults[10] and faults[7] == faults[8] == faults[9] == [("", "not JSON")]
    at = "redacted_dom_summary[{}].{}".format
    assert faults[12] == [(at(0, "row"), "above 10000"), (at(1, "row"), "below 1"), (at(2, "row"), "not an integer"), (at(3, "row"), "not an integer"), (at(4, "row"), "not an integer"), (at(5, "filled"), "not a flag")]
    assert bodies[0].redacted_dom_summary[0].position.width == 3.0 and bodies[0].redacted_dom_summary[0].row is None and bodies[2] is None
    assert [(e.row, e.filled) for e in bodies[11].redacted_dom_summary] == [(1, None), (10_000, None), (7, None), (3, None), (1, None), (None, True), (None, False)]


def test_refusals_name_the_request(spark):
    rows = [(1, json.dumps(changed(task_query=""))), (2, "x"), (3, json.dumps(changed(request_id=7))), (4, json.dumps(GOOD)), (5, "[1]")]
    told = requests.refusals(requests.validated(spark.createDataFrame(rows, "k long, value string")), "k").collect()
    assert sorted((r.k, r.request_id, r.error_code, r.status) for r in told) == [(k, i, "MALFORMED_REQUEST", 400) for k, i in ((1, "r1"), (2, ""), (3, ""), (5, ""))]


def test_closed_strict_shapes_judge_reports_as_the_fleet_does(spark):
    count = Shape({"category": Text(among=fleet.CATEGORIES), "count": Number(0, fleet.MOST_COUNT, integer=True, lenient=False)}, closed=True)
    entry = Shape(
        {"at": Number(0, integer=True, lenient=False), "kind": Text(among=("run", "scan")), "examined": Text(among=("viewport", "document", "document-partial")), "transmitted": Flag(lenient=False), "counts": Many(count, fleet.MOST_COUNTS), "total": Number(0, fleet.MOST_COUNT, integer=True, lenient=False), "durationMs": Number(0, lenient=False)},
        optional=frozenset(("durationMs",)),
        closed=True,
    )
    report = Shape({"device_id": Text(pattern="^[A-Za-z0-9-]{8,64}$"), "device_name": Text(1, fleet.MOST_NAME), "team": Text(1, fleet.MOST_NAME), "entries": Many(entry, fleet.MOST_ENTRIES)}, closed=True)
    one = {"at": 1, "kind": "run", "examined": "viewport", "transmitted": True, "counts": [{"category": "email", "count": 2}], "total": 2, "durationMs": 1.5}
    good = {"device_id": "device-01", "device_name": "n", "team": "t", "entries": [one]}
    bodies = [good, good | {"extra": 1}, good | {"device_id": "short"}, good | {"entries": [one | {"kind": "other"}]}, good | {"entries": [one | {"counts": [{"category": "email", "count": -1}]}]}, good | {"entries": [one | {"durationMs": None}]}, good | {"entries": [one | {"more": 1}]}, good | {"team": ""}, good | {"entries": [one] * 201}, "{", good | {"entries": [one | {"transmitted": None}]}]
    faults, _ = found(spark, *bodies, shape=report)
    rows = spark.createDataFrame([(k, b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "k long, value string")
    assert [not f for f in faults] == [r.refused is None for r in fleet.validated(rows).orderBy("k").collect()]
    assert faults[1] == [("extra", "unknown name")] and faults[6] == [("entries[0].more", "unknown name")]


def test_whole_json_and_kinds(spark):
    texts = ['{"a":1}', '{"a":1} {"b":2}', '{"a":1},{"b":2}', "[1] x", "1.5", "12345678901234567890123", "true", "null", '"t"', "", None, "]", "1],[2", '{"a":1,}', '{"a":1}] x', '1,"2"', " 7 "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    assert [r[0] for r in df.orderBy("k").select(jsons.kind(jsons.whole(F.col("t")))).collect()] == ["object", None, None, None, "number", "integer", "flag", "null", "text", None, None, None, None, None, None, None, "integer"]


ELEMENTS = [(1, "e0", "button", "Pay", None, None), (1, "e1", "text", "Fee pending", None, 2), (1, "e2", "button", "Release", None, 2), (1, "e3", "input", "[PASSWORD]", "Secret", None), (1, "e4", "input", None, "Name", None), (1, "e5", "text", "Ready", None, 2)]


def judged(spark, *given, task="pay the fee"):
    elements = spark.createDataFrame([(p, k, i, t, label, v, r) for k, (p, i, t, v, label, r) in enumerate(ELEMENTS)], "page_id long, ord int, element_id string, element_type string, label string, value string, row int").withColumn("input_type", F.lit(None).cast("string"))
    rows = [(k, 1, task, g if isinstance(g, str) else json.dumps(g)) for k, g in enumerate(given)]
    return replies.interpreted(spark.createDataFrame(rows, "reply_id long, page_id long, task string, reply string"), elements).orderBy("reply_id").collect()


def reply(**parts):
    return {"status": "action_ready", "action": {"type": "click", "selector": "e0"}, "confidence": 0.75, "reasoning_summary": "ok"} | parts


def test_replies_are_read_as_a_whole(spark):
    good = json.dumps(reply())
    got = judged(
        spark,
        good,
        f"```json\n{good}\n```",
        f'{good} or rather {{"status":"needs_more_context"}}',
        f"{good} }}",
        f"{good}] and {good}",
        f"<think>{{ no }}</think>{good}",
        f"<THOUGHT>{good}",
        "{not json}",
        "[1, 2]",
        f"[{good}]",
        "} {",
        '{"status":"needs_more_context","reasoning_summary":5}',
        "",
    )
    assert [r.refused for r in got] == [None, None, "not valid", "not valid", "not valid", None, "ended inside its reasoning", "not valid", "no object", None, "no object", None, "no object"]
    assert [r.action for r in got[:6]] == ["click", "click", None, None, None, "click"]
    assert got[11].confidence == 0.0 and got[11].summary == replies.NO_SUMMARY


def test_values_of_replies_keep_their_kind(spark):
    typed = lambda v, to="e4": reply(action={"type": "type", "selector": to, "value": v})
    sure = [0.8333333333, 0.1234567, 1, 0, True, "0.9", 7.5, -0.1, None, [0.5]]
    got = judged(spark, *[reply(confidence=c) for c in sure], typed(5), typed("5"), typed(["a"]), typed(None), typed(""), typed("x", "e3"), typed("[USE_SAVED_CREDENTIAL]", "e3"), reply(action={"type": "click", "selector": 0}), reply(action={"type": ["click"], "selector": "e0"}), reply(action="click"), reply(status=1), reply(action={"type": "click", "selector": "e0", "value": 5}), reply(action={"type": "click", "selector": "e0", "value": ""}))
    assert [r.confidence for r in got[:10]] == [0.8333333333, 0.1234567, 1.0, 0.0, 1.0, 0.5, 0.5, 0.5, 0.5, 0.5]
    assert [r.refused for r in got[10:]] == ["value is no text", None, "value is no text", "nothing to type", "nothing to type", "literal for a redacted field", None, "element not in the page", "action not allowed", "no action", "no recognised status", "value is no text", None]
    assert got[11].value == "5"


def test_evidence_of_a_click_in_a_row(spark):
    click = lambda e: reply(action={"type": "click", "selector": "e2"}, evidence=e)
    cite = lambda i, t: {"elementId": i, "text": t}
    got = judged(spark, click(None), click("e1"), click([]), click(["e1"]), click([cite("e5", " ready ")]), click([cite("e9", "x")]), click([cite("e5", 5)]), click([cite("e0", "Pay")]), click([cite("e5", "steady")]), click([cite("e1", "Fee")]), click([cite("e5", "Ready"), cite("e1", "fee pending")]))
    assert [r.refused for r in got] == ["no evidence", "no evidence", None, "evidence is no list of elements", None, "cited element not on the page", "cited element not on the page", "evidence from another row", "quoted words not there", "evidence shows an unmet condition", "evidence shows an unmet condition"]
    assert judged(spark, click([cite("e1", "Fee")]), task="those whose fee is PENDING")[0].refused is None


def test_a_body_is_taken_apart_once(spark):
    df = spark.createDataFrame([(1, "x")], "k long, value string")
    used = requests.validated(df).where("body is not null").select("k", F.explode("body.redacted_dom_summary").alias("e")).select("k", "e.filled", "e.row", "e.position.height")
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant") < 100 and len(plan) < 60_000


def test_fits_agrees_with_faults(spark):
    shape = Shape({"a": Text(1), "n": Number(0, integer=True), "l": Many(Many(Flag(), 2)), "o": Shape({"x": Number(lenient=False)}, optional=frozenset(("x",)), closed=True), "quo`ted": Text()}, optional=frozenset(("n", "quo`ted")), defaulted=frozenset(("o",)))
    good = {"a": "t", "n": "7", "l": [[True, "no"], []], "o": {"x": 1}}
    bodies = [good, good | {"a": None}, good | {"a": {"b": [1]}}, good | {"n": None}, good | {"n": 1.5}, good | {"n": "-1"}, good | {"l": [[1, 2, 3]]}, good | {"l": [True]}, good | {"l": {}}, good | {"l": [["x"]]}, good | {"o": None}, good | {"o": {"x": None}}, good | {"o": {"x": "1"}}, good | {"o": {"y": 1}}, good | {"quo`ted": 1}, {"a": "t", "l": []}, [good], "7"]
    df = spark.createDataFrame([(k, b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "k long, t string")
    v = jsons.whole(F.col("t"))
    got = df.orderBy("k").select(jsons.fits(shape, v).alias("fits"), jsons.faults(shape, v, F.lit("")).alias("faults")).collect()
    assert [r.fits for r in got] == [not r.faults for r in got] == [k in (0, 3, 11, 15) for k in range(len(bodies))]
    assert [tuple(f) for r in got[6:10] for f in r.faults] == [("l[0]", "more than 2 items"), ("l[0]", "not a list"), ("l", "not a list"), ("l[0][0]", "not a flag")]
