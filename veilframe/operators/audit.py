"""Counts-only audit entries: tallies, capped logs, totals, compliance summaries and fleet rollups.

An audit table has device_id, at (epoch milliseconds), kind (run or scan), transmitted, total, duration_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP, DAYS, DAY_MS = 200, 7, 86_400_000


def tally(rows: DataFrame, *keys: str, category: str = "category") -> DataFrame:
    """Count per category (and keys), as the audit shows it."""
    return rows.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("count"))


def capped(audit: DataFrame, cap: int = CAP, device: str = "device_id", at: str = "at", tie: str = "entry_id") -> DataFrame:
    """The newest ``cap`` entries of each device, one at least."""
    newest = Window.partitionBy(device).orderBy(F.desc(at), F.desc(tie))
    return audit.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max(1, cap)).drop("_n")


#: Ranges of one step of the search for a median, and values that are sorted in the end.
RANGES, SORTED = 4096, 100_000


def exact_median(rows: DataFrame, column: str) -> float | None:
    """The median of a column over all rows; null if it has none. No task holds more than ``SORTED`` of its values: the
    range that holds the middle is narrowed by counts of sub-ranges, of which the driver sees ``RANGES`` rows each time."""
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return None

    def at(rank: int) -> float:
        lo, hi, before, inside = low, high, 0, n
        while inside > SORTED and lo < hi:
            part = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / RANGES)), F.lit(RANGES - 1))
            counted = values.where(F.col("v").between(lo, hi)).groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            for r in sorted(counted.collect(), key=lambda r: r["b"]):
                if rank < before + r["c"]:
                    lo, hi, inside = r["lo"], r["hi"], r["c"]
                    break
                before += r["c"]
        if lo == hi:
            return lo
        return values.where(F.col("v").between(lo, hi)).orderBy("v").offset(rank - before).limit(1).first()["v"]

    first = at((n - 1) // 2)
    return first if n % 2 else (first + at(n // 2)) / 2


def totals(audit: DataFrame, *keys: str) -> DataFrame:
    """Items, entries by kind, entries sent and kept, first and last time, median duration of runs."""
    run = F.col("kind") == "run"
    if keys:
        median = F.median(F.when(run, F.col("duration_ms")))
    else:
        found = exact_median(audit.where(run), "duration_ms")
        median = F.max(F.lit(found).cast("double"))
    return audit.groupBy(*keys).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("items"),
        F.count_if(run).alias("runs"),
        F.count_if(F.col("kind") == "scan").alias("scans"),
        F.count_if("transmitted").alias("sent"),
        F.count_if(~F.col("transmitted")).alias("kept"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        median.alias("median_run_ms"),
    )


def calendar_days(audit: DataFrame, now_ms: int, days: int = DAYS) -> DataFrame:
    """(day, entries, items) for the last calendar days of the session's time zone, empty days too."""
    spark = audit.sparkSession
    today = F.to_date(F.timestamp_millis(F.lit(now_ms)))
    wanted = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    own = audit.groupBy(F.to_date(F.timestamp_millis("at")).alias("day")).agg(F.count(F.lit(1)).alias("entries"), F.sum("total").alias("items"))
    zero = F.lit(0).cast("long")
    return wanted.join(own, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("entries", zero).alias("entries"), F.coalesce("items", zero).alias("items"))


def rolling_age(at: Column, now_ms: int) -> Column:
    """Whole days of 24 hours since ``at``; -1 for the future."""
    return F.floor((F.lit(now_ms) - at) / DAY_MS)


def rolling_days(audit: DataFrame, now_ms: int, days: int = DAYS) -> DataFrame:
    """(age_days, items) for the last ``days`` periods of 24 hours, empty ones too."""
    wanted = audit.sparkSession.range(days).select(F.col("id").alias("age_days"))
    own = audit.select(rolling_age(F.col("at"), now_ms).alias("age_days"), "total").groupBy("age_days").agg(F.sum("total").alias("items"))
    return wanted.join(own, "age_days", "left").select("age_days", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


def fleet(audit: DataFrame) -> DataFrame:
    """Per device: items hidden, runs, scans and transmissions, and when it was last seen."""
    return audit.groupBy("device_id").agg(
        F.sum("total").alias("hidden"),
        F.count_if(F.col("kind") == "run").alias("tasks"),
        F.count_if(F.col("kind") == "scan").alias("scans"),
        F.count_if("transmitted").alias("sent"),
        F.max("at").alias("last_seen"),
    )


def rate(n: Column, d: Column, default: float = 1.0) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(default))
