"""Queries over fleet reports that follow from ``events``: validation of raw JSON, reports of devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import fleet
from veilframe.plans.registry import query
from veilframe.tables import table


def _raw(spark, sf_dir):
    """One report for each event; what is wrong with it follows from the event's key."""
    e = F.col("event_id")
    m = e % 14
    number = F.floor("value").cast("long")
    count = F.to_json(F.struct(F.when(m == 1, "salary").otherwise("email").alias("category"), F.when(m == 2, F.lit(100_001)).otherwise(number).alias("count")))
    counted = F.concat(F.lit("["), F.array_join(F.array_repeat(count, F.when(m == 3, 17).otherwise(2)), ","), F.lit("]"))
    ts = F.when(m == 4, F.lit(-5)).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))).cast("string")
    kind = F.when(m == 5, "look").otherwise("run")
    took = F.when(m == 6, "-1").when(m == 7, '"long"').when(m == 8, "null").otherwise("12.5")
    more = F.when(m == 9, ',"url":"x"').otherwise("")
    entry = F.concat(F.lit('{"at":'), ts, F.lit(',"kind":"'), kind, F.lit('","examined":"viewport","transmitted":true,"counts":'), counted, F.lit(',"total":7,"durationMs":'), took, more, F.lit("}"))
    name = F.when(m == 10, "deviceName").otherwise("device_name")
    device = F.when(m == 11, "short").otherwise(F.concat(F.lit("device-"), F.lpad(F.col("user_id").cast("string"), 6, "0")))
    team = F.when(m == 12, "").otherwise("team")
    text = F.concat(F.lit('{"device_id":"'), device, F.lit('","'), name, F.lit('":"Laptop","team":"'), team, F.lit('","entries":['), entry, F.lit("]}"))
    return table(spark, sf_dir, "events").select("event_id", F.when(m == 13, F.lit("not json")).otherwise(text).alias("value"))


@query("""
SELECT event_id, CASE WHEN m IN (0, 8) THEN NULL WHEN m = 13 THEN 'not an object' WHEN m IN (9, 10) THEN 'unknown field' ELSE 'value out of bounds' END AS refused,
  CASE WHEN m IN (0, 8) THEN 'device-' || lpad(user_id::VARCHAR, 6, '0') END AS device_id FROM (SELECT *, event_id % 14 AS m FROM events)
""")
def fleet_validation(spark, sf_dir):
    return fleet.validated(_raw(spark, sf_dir)).select("event_id", "refused", "report.device_id")


@query("""
SELECT user_id AS device_id, '{"device_id":"' || user_id || '","device_name":"' || CASE WHEN user_id % 3 = 0 THEN 'Laptop' ELSE 'Device ' || user_id END || '","team":"' || CASE WHEN user_id % 2 = 0 THEN 'Unassigned' ELSE 'Team' END || '","entries":[' ||
  string_agg('{"at":' || "at" || ',"kind":"run","examined":"viewport","transmitted":false,"counts":[{"category":"email","count":' || event_id % 9 || '}],"total":' || event_id % 9 || ',"durationMs":null}', ',' ORDER BY "at", event_id) || ']}' AS report
FROM (SELECT *, (epoch_us(ts) // 1000) AS "at" FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) <= 5) GROUP BY user_id
""")
def fleet_reports(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    entries = table(spark, sf_dir, "events").select(
        u.cast("string").alias("device_id"), F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("Device "), u.cast("string"))).alias("device_name"), F.when(u % 2 == 0, F.lit(None)).otherwise("Team").alias("team"),
        e.alias("entry_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit("run").alias("kind"), F.lit("viewport").alias("examined"), F.lit(False).alias("transmitted"),
        F.array(F.struct(F.lit("email").alias("category"), (e % 9).alias("count"), F.lit("rule").alias("rules"))).alias("counts"), (e % 9).alias("total"), F.lit(None).cast("double").alias("duration_ms"),
    )
    made = fleet.report_of(entries, 5)
    return made.select(F.col("device_id").cast("long").alias("device_id"), "report")
