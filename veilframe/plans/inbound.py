"""Queries over requests as they arrive: a body for each order, an element for each of its lines; what is wrong follows from the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import requests
from veilframe.plans.registry import query
from veilframe.tables import table

#: What a line's number among eleven makes of its element, and an order's among seventeen of its body.
_ENTRY = {
    0: '{"elementId":"e%d","elementType":"input","label":null,"value":"[NAME]","filled":true,"row":%d,"position":{"x":1,"y":2.5,"width":"30","height":true},"other":1}',
    1: '{"elementId":%d,"elementType":"text","row":%d,"position":{"x":1,"y":2,"width":3,"height":4}}',
    2: '{"elementId":"e%d","elementType":"link","row":null,"position":{"x":1,"y":2,"width":3,"height":%d}}',
    3: '{"elementId":"e%d","elementType":"button","row":0,"position":{"x":1,"y":2,"width":3,"height":%d}}',
    4: '{"elementId":"e%d","elementType":"button","row":%d.5,"position":{"x":1,"y":2,"width":3,"height":4}}',
    5: '{"elementId":"e%d","elementType":"image","filled":null,"position":{"x":null,"y":"wide","width":3,"height":%d}}',
    6: '{"elementId":"e%d","elementType":"image","filled":"off","label":5,"position":[%d]}',
    7: '{"elementId":"e%d","elementType":"other","filled":"maybe","row":"%d","position":{"y":2,"width":3,"height":4}}',
    8: '"e%d%d"',
}
_ENTRY_FAULTS = {
    1: [("elementId", "not a text")],
    2: [("elementType", "not one of the known")],
    3: [("row", "below 1")],
    4: [("row", "not an integer")],
    5: [("filled", "not a flag"), ("position.x", "not a number"), ("position.y", "not a number")],
    6: [("label", "not a text"), ("position", "not an object")],
    7: [("filled", "not a flag"), ("position.x", "missing")],
    8: [("", "not an object")],
}
_HEAD = {
    0: '{"request_id":"r%d","task_query":"","redacted_frame":"f",',
    1: '{"request_id":%d,"task_query":"pay","redacted_frame":"f",',
    2: '{"request_id":"r%d","redacted_frame":null,',
    3: 'not {"request_id":"r%d","task_query":"pay","redacted_frame":"f",',
    4: '[{"request_id":"r%d","task_query":"pay","redacted_frame":"f",',
}
_HEAD_FAULTS = {0: [("task_query", "shorter than 1")], 1: [("request_id", "not a text")], 2: [("task_query", "missing"), ("redacted_frame", "not a text")]}
_TAIL_FAULTS = {5: [("redaction_manifest", "missing")], 6: [("redaction_manifest[0].category", "not one of the known"), ("redaction_manifest[0].method", "missing")], 7: [("redaction_manifest", "not a list")]}
_TAIL = {5: "}", 6: ',"redaction_manifest":[{"regionId":"a","category":"secret"}]}', 7: ',"redaction_manifest":{}}', 8: ',"redaction_manifest":[]} {"more":1}'}
_GOOD_HEAD, _GOOD_TAIL, _GOOD_ENTRY = '{"request_id":"r%d","task_query":"pay","redacted_frame":"f",', ',"redaction_manifest":[{"regionId":"a","category":"email","method":"ocr"}]}', '{"elementId":"e%d","elementType":"text","label":"l","position":{"x":-1e2,"y":0,"width":3,"height":%d}}'


def _bodies(spark, sf_dir) -> DataFrame:
    """(request, value): entries only for every third order, or most bodies would be refused."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    k = F.pmod(o * 3 + n * 5, F.lit(11))
    entry = F.format_string(_GOOD_ENTRY, n, n)
    for at, form in _ENTRY.items():
        entry = F.when((k == at) & (o % 3 == 0), F.format_string(form, n, n)).otherwise(entry)
    lines = table(spark, sf_dir, "lineitem").select(o, n, entry.alias("entry"))
    listed = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "entry"))), lambda x: x["entry"]), ",").alias("entries"))
    m = o % 17
    head, tail = F.format_string(_GOOD_HEAD, o), F.lit(_GOOD_TAIL)
    for at, form in _HEAD.items():
        head = F.when(m == at, F.format_string(form, o)).otherwise(head)
    for at, form in _TAIL.items():
        tail = F.when(m == at, form).otherwise(tail)
    tail = F.when(m == 4, F.concat(tail, F.lit("]"))).otherwise(tail)
    return listed.select(o.alias("request"), F.concat(head, F.lit('"redacted_dom_summary":['), "entries", F.lit("]"), tail).alias("value"))


def _cases(found: dict, of: str) -> str:
    each = lambda pairs: "[" + ", ".join(f"{{'path': '{p}', 'fault': '{f}'}}" for p, f in pairs) + "]"
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN {each(v)}" for k, v in found.items()) + " ELSE [] END"


_FAULTS_SQL = f"""
bodies AS (SELECT DISTINCT l_orderkey AS o, l_orderkey % 17 AS m FROM lineitem),
entries AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, (l_orderkey * 3 + l_linenumber * 5) % 11 AS k FROM lineitem WHERE l_orderkey % 3 = 0),
faults AS (
  SELECT o, '' AS path, CASE m WHEN 4 THEN 'not an object' ELSE 'not JSON' END AS fault FROM bodies WHERE m IN (3, 4, 8)
  UNION ALL SELECT o, f.path, f.fault FROM (SELECT o, unnest({_cases(_HEAD_FAULTS | _TAIL_FAULTS, 'm')}) AS f FROM bodies)
  UNION ALL SELECT o, 'redacted_dom_summary[' || i || ']' || CASE WHEN f.path = '' THEN '' ELSE '.' || f.path END, f.fault FROM (SELECT o, i, unnest({_cases(_ENTRY_FAULTS, 'k')}) AS f FROM entries) WHERE o % 17 NOT IN (3, 4, 8))"""


@query(f"WITH {_FAULTS_SQL} SELECT o AS request, path, fault FROM faults")
def request_validation(spark, sf_dir):
    return requests.quarantined(requests.judged(_bodies(spark, sf_dir)), "request").select("request", "path", "fault")


@query(f"WITH {_FAULTS_SQL} SELECT DISTINCT o AS request, CASE WHEN o % 17 IN (1, 3, 4, 8) THEN '' ELSE 'r' || o END AS request_id, 'MALFORMED_REQUEST' AS error_code, 400 AS status FROM faults")
def request_refusals(spark, sf_dir):
    return requests.refusals(requests.judged(_bodies(spark, sf_dir)), "request")


@query(f"""WITH {_FAULTS_SQL}, lines AS (SELECT l_orderkey AS o, (l_orderkey * 3 + l_linenumber * 5) % 11 = 0 AND l_orderkey % 3 = 0 AS odd, l_linenumber AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o FROM faults))
SELECT o AS request, count(*) AS elements, count_if(odd) AS filled, coalesce(sum(CASE WHEN odd THEN n END), 0)::BIGINT AS rows, sum(CASE WHEN odd THEN 1 ELSE n END)::DOUBLE AS heights FROM lines GROUP BY o
""")
def request_elements(spark, sf_dir):
    good = requests.validated(_bodies(spark, sf_dir)).where("body is not null").select("request", F.explode("body.redacted_dom_summary").alias("e"))
    sums = good.groupBy("request").agg(F.count(F.lit(1)).alias("elements"), F.count_if("e.filled").alias("filled"), F.coalesce(F.sum("e.row"), F.lit(0).cast("long")).alias("rows"), F.sum("e.position.height").alias("heights"))
    return sums

