"""Queries over events as audit entries: a user stands for a device, an event for an entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import audit
from veilframe.operators.fleet import latest
from veilframe.plans.registry import query
from veilframe.tables import table

NOW_MS = 1_706_659_200_000  # 31 January 2024, 00:00 UTC

_AUDIT_SQL = """(SELECT user_id AS device_id, event_id AS entry_id, (epoch_us(ts) // 1000)::BIGINT AS "at", CASE WHEN event_type IN ('click', 'purchase') THEN 'run' ELSE 'scan' END AS kind,
  event_type IN ('purchase', 'signup') AS transmitted, floor(value)::BIGINT AS total, value AS duration_ms, event_type FROM events)"""


def _audit(spark, sf_dir) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("entry_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
        F.when(e.isin("click", "purchase"), "run").otherwise("scan").alias("kind"),
        e.isin("purchase", "signup").alias("transmitted"),
        F.floor("value").cast("long").alias("total"),
        F.col("value").alias("duration_ms"),
        "event_type",
    )


@query(f"""SELECT device_id, event_type, count(*) AS count FROM {_AUDIT_SQL} GROUP BY ALL""")
def audit_tally(spark, sf_dir):
    return audit.tally(_audit(spark, sf_dir), "device_id", category="event_type")


@query(f"""SELECT device_id, entry_id, "at" FROM {_AUDIT_SQL} QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY "at" DESC, entry_id DESC) <= 5""")
def audit_cap_newest(spark, sf_dir):
    return audit.capped(_audit(spark, sf_dir), 5).select("device_id", "entry_id", "at")


_TOTALS = """sum(total)::BIGINT AS items, count_if(kind = 'run') AS runs, count_if(kind = 'scan') AS scans, count_if(transmitted) AS sent, count_if(NOT transmitted) AS kept, min("at") AS first_at, max("at") AS last_at, median(CASE WHEN kind = 'run' THEN duration_ms END) AS median_run_ms"""


@query(f"""SELECT {_TOTALS} FROM {_AUDIT_SQL}""")
def compliance_summary(spark, sf_dir):
    return audit.totals(_audit(spark, sf_dir))


@query(f"""SELECT device_id, {_TOTALS} FROM {_AUDIT_SQL} GROUP BY device_id""")
def device_summary(spark, sf_dir):
    return audit.totals(_audit(spark, sf_dir), "device_id")


@query(f"""
SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(entries, 0) AS entries, coalesce(items, 0)::BIGINT AS items
FROM (SELECT (make_timestamp({NOW_MS}::BIGINT * 1000)::DATE - i::INT) AS d FROM range(7) r(i))
LEFT JOIN (SELECT make_timestamp("at" * 1000)::DATE AS d, count(*) AS entries, sum(total) AS items FROM {_AUDIT_SQL} GROUP BY 1) USING (d)
""")
def last_seven_days_calendar(spark, sf_dir):
    return audit.calendar_days(_audit(spark, sf_dir), NOW_MS)


@query(f"""
SELECT i AS age_days, coalesce(items, 0)::BIGINT AS items FROM range(7) r(i)
LEFT JOIN (SELECT floor(({NOW_MS} - "at") / 86400000.0)::BIGINT AS i, sum(total) AS items FROM {_AUDIT_SQL} GROUP BY 1) USING (i)
""")
def last_seven_days_rolling(spark, sf_dir):
    return audit.rolling_days(_audit(spark, sf_dir), NOW_MS)


@query(f"""SELECT device_id, sum(total)::BIGINT AS hidden, count_if(kind = 'run') AS tasks, count_if(kind = 'scan') AS scans, count_if(transmitted) AS sent, max("at") AS last_seen FROM {_AUDIT_SQL} GROUP BY device_id""")
def fleet_rollup(spark, sf_dir):
    return audit.fleet(_audit(spark, sf_dir))


@query(f"""SELECT device_id, entry_id, "at", event_type FROM {_AUDIT_SQL} QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY "at" DESC, entry_id DESC) = 1""")
def fleet_latest(spark, sf_dir):
    return latest(_audit(spark, sf_dir), "device_id", "at", "entry_id").select("device_id", "entry_id", "at", "event_type")


@query(f"""
SELECT kind, event_type, count(*) AS entries, sum(total)::BIGINT AS items FROM {_AUDIT_SQL} GROUP BY ROLLUP (kind, event_type)
""")
def fleet_totals(spark, sf_dir):
    return _audit(spark, sf_dir).rollup("kind", "event_type").agg(F.count(F.lit(1)).alias("entries"), F.sum("total").alias("items"))


@query(f"""
SELECT event_type AS stage, calls, total_ms, total_ms / sum(total_ms) OVER () AS share, over_budget
FROM (SELECT event_type, count(*) AS calls, sum(duration_ms) AS total_ms, count_if(duration_ms > 100) AS over_budget FROM {_AUDIT_SQL} GROUP BY event_type)
""")
def stage_share(spark, sf_dir):
    rows = _audit(spark, sf_dir)
    stages = rows.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("total_ms"), F.count_if(F.col("duration_ms") > 100).alias("over_budget"))
    whole = rows.agg(F.sum("duration_ms").alias("wall"))  # one row
    return stages.crossJoin(F.broadcast(whole)).select("stage", "calls", "total_ms", audit.rate(F.col("total_ms"), F.col("wall"), 0.0).alias("share"), "over_budget")
