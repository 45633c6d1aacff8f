"""Queries over stores: turns of a conversation as a device's transmissions, events as audit entries, lines of orders as timed stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import replies, stores
from veilframe.plans.registry import query
from veilframe.plans.rollups import _AUDIT_SQL, NOW_MS, _audit
from veilframe.tables import table


def _sent(spark, sf_dir) -> DataFrame:
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("device_id"), t.alias("entry_id"), t.alias("at"), F.col("text").alias("json"), F.repeat("text", (1 + t % 3).cast("int")).alias("frame"))


@query("""
WITH sent AS (SELECT conv_id AS device_id, turn AS entry_id, text AS json, repeat(text, 1 + turn % 3) AS frame FROM conversations),
newest AS (SELECT *, strlen(coalesce(frame, '')) AS frame_bytes, strlen(coalesce(json, '')) AS text_bytes FROM sent QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY entry_id DESC) <= 4)
SELECT device_id, entry_id, sha256(json) AS text_sha256, frame_bytes,
  sum(text_bytes) OVER (PARTITION BY device_id) + sum(frame_bytes) OVER (PARTITION BY device_id ORDER BY entry_id DESC) <= 6000 AND frame_bytes >= 0 AS has_frame,
  '<redacted image, ' || floor(frame_bytes / 1024 + 0.5)::BIGINT || 'KB, omitted here for length>' AS frame_note FROM newest
""")
def evidence_kept(spark, sf_dir):
    kept = stores.kept_evidence(_sent(spark, sf_dir), budget=6000, cap=4)
    return kept.select("device_id", "entry_id", F.sha2("json", 256).alias("text_sha256"), "frame_bytes", F.col("frame").isNotNull().alias("has_frame"), "frame_note")


@query("""
WITH screens AS (SELECT c_nationkey AS device_id, c_custkey // 10 AS proof_id, c_custkey // 20 AS moment, c_custkey % 10 * 7 % 10 AS stop, c_custkey % 4 > 0 AS painted FROM customer),
proofs AS (SELECT *, max(moment) OVER p AS latest, count(*) FILTER (NOT painted) OVER p AS omitted FROM screens WINDOW p AS (PARTITION BY device_id, proof_id)),
newest AS (SELECT * FROM proofs QUALIFY dense_rank() OVER (PARTITION BY device_id ORDER BY latest DESC, proof_id DESC) = 1)
SELECT device_id, proof_id, stop, omitted FROM newest WHERE painted QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY stop) <= 3
""")
def proof_kept(spark, sf_dir):
    k = F.col("c_custkey")
    screens = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("device_id"), F.floor(k / 10).alias("proof_id"), F.floor(k / 20).alias("at"), (k % 10 * 7 % 10).alias("stop"), (k % 4 > 0).alias("painted"))
    return stores.kept_proofs(screens, most=3).select("device_id", "proof_id", "stop", "omitted")


@query(f"""
SELECT device_id, sha256('{{"generatedAt":"2024-01-31T00:00:00.000Z","note":"categories, counts and times only","entries":[' || string_agg('{{"at":"' || strftime(make_timestamp("at" * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","kind":"' || kind || '","transmitted":' || transmitted || ',"total":' || total || '}}', ',' ORDER BY "at" DESC, entry_id DESC) || ']}}') AS json_sha256
FROM {_AUDIT_SQL} GROUP BY device_id
""")
def audit_export(spark, sf_dir):
    told = stores.audit_json(_audit(spark, sf_dir), NOW_MS, ("kind", "transmitted", "total"))
    return told.select("device_id", F.sha2("json", 256).alias("json_sha256"))


@query("""
SELECT stage, count(*) AS n, min(ms) AS least, max(ms) AS most, avg(ms) AS mean, list_sort(list(ms))[ceil(count(*) * 0.5)::INT] AS q50, list_sort(list(ms))[ceil(count(*) * 0.95::DOUBLE)::INT] AS q95
FROM (SELECT c_mktsegment AS stage, c_custkey * 7919 % 10007 AS ms FROM customer) GROUP BY stage
""")
def bench_latency(spark, sf_dir):
    timed = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stage"), (F.col("c_custkey") * 7919 % 10007).alias("ms"))
    return stores.latency(timed, "stage")


_RESPONSES = {
    0: '{"request_id":"r%d","status":"action_ready","action":{"type":"click","selector":"e1","value":5},"reasoning_summary":"ok"}',
    1: '{"request_id":%d,"status":"needs_more_context","reasoning_summary":7}',
    2: '{"request_id":"r%d","status":"error","error_code":"ACTION_REJECTED"}',
    3: '{"request_id":"r%d","status":"error","error_code":5}',
    4: '{"request_id":"r%d","status":"done"}',
    5: '{"request_id":"r%d","status":"action_ready"}',
    6: '{"request_id":"r%d","status":"action_ready","action":{"type":"upload","selector":"e1"}}',
    7: '{"request_id":"r%d","status":"action_ready","action":{"type":"type","selector":"","value":"x"}}',
    8: '{"request_id":"r%d","status":"action_ready","action":{"type":"type","selector":"e2","value":"x"}} trailing',
    9: "[%d]",
    10: '{"request_id":"r%d","status":"action_ready","action":{"type":"type","selector":"e2","value":"x"}}',
    11: '"%d"',
}


@query("""
SELECT o_orderkey AS k, CASE WHEN m IN (1, 8, 9, 11) THEN '' ELSE 'r' || o_orderkey END AS request_id, CASE m WHEN 0 THEN 'action' WHEN 10 THEN 'action' WHEN 1 THEN 'needs_more_context' ELSE 'refused' END AS outcome,
  CASE m WHEN 0 THEN 'click' WHEN 10 THEN 'type' END AS action, CASE m WHEN 10 THEN 'x' END AS typed, CASE m WHEN 0 THEN 'ok' END AS summary,
  CASE m WHEN 2 THEN 'error ACTION_REJECTED' WHEN 3 THEN 'error of no known code' WHEN 4 THEN 'unknown status' WHEN 5 THEN 'no action' WHEN 6 THEN 'action not allowed' WHEN 7 THEN 'no selector' WHEN 8 THEN 'not JSON' WHEN 9 THEN 'unknown status' WHEN 11 THEN 'not an object' END AS refused
FROM (SELECT *, o_orderkey % 12 AS m FROM orders)
""")
def response_parsing(spark, sf_dir):
    o = F.col("o_orderkey")
    body = F.lit(None).cast("string")
    for m, form in _RESPONSES.items():
        body = F.when(o % 12 == m, F.format_string(form, o)).otherwise(body)
    told = replies.responses(table(spark, sf_dir, "orders").select(o.alias("k"), body.alias("value")))
    return told.select("k", "request_id", "outcome", "action", "typed", "summary", "refused")
