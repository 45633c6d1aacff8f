"""Fleet reports: strict validation of raw JSON, and a keyed replacement that replays leave unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the report format.
CATEGORIES = ("password", "name", "email", "phone", "address", "face", "id_number", "other")
KEYS = {"report": ("device_id", "device_name", "entries", "team"), "entry": ("at", "counts", "durationMs", "examined", "kind", "total", "transmitted"), "count": ("category", "count")}
MOST_ENTRIES, MOST_COUNTS, MOST_COUNT, MOST_NAME = 200, 16, 100_000, 40
SCHEMA = "device_id string, device_name string, team string, entries array<struct<at:bigint,kind:string,examined:string,transmitted:boolean,counts:array<struct<category:string,count:bigint>>,total:bigint,durationMs:double>>"


def _only(keys: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0


def validated(raw: DataFrame, value: str = "value") -> DataFrame:
    """``raw`` with ``report``, the parsed report or null, and ``refused``, why it is null.

    A whole report is refused for any unknown field at any level or any value out of its bounds.
    """
    text = F.col(value)
    report = F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"})
    entries = F.from_json(F.get_json_object(text, "$.entries"), "array<string>")
    counts = F.flatten(F.transform(entries, lambda e: F.coalesce(F.from_json(F.get_json_object(e, "$.counts"), "array<string>"), F.array().cast("array<string>"))))
    keys = F.json_object_keys
    # a value of another kind reads as null, which only durations may be
    plain = F.forall(entries, lambda e: (F.get_json_object(e, "$.durationMs").isNull()) | F.coalesce(F.get_json_object(e, "$.durationMs").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), F.lit(False)))
    known = _only(keys(text), KEYS["report"]) & F.forall(entries, lambda e: _only(keys(e), KEYS["entry"])) & F.forall(counts, lambda c: _only(keys(c), KEYS["count"]))
    r = report
    good_entry = lambda e: (
        e["kind"].isin("run", "scan")
        & e["examined"].isin("viewport", "document", "document-partial")
        & (e["at"] >= 0)
        & F.coalesce(e["durationMs"] >= 0, F.lit(True))
        & e["transmitted"].isNotNull()
        & e["total"].between(0, MOST_COUNT)
        & (F.size(e["counts"]) <= MOST_COUNTS)
        & F.forall(e["counts"], lambda c: c["category"].isin(*CATEGORIES) & c["count"].between(0, MOST_COUNT))
    )
    bounded = r["device_id"].rlike("^[A-Za-z0-9-]{8,64}$") & F.length(r["device_name"]).between(1, MOST_NAME) & F.length(r["team"]).between(1, MOST_NAME) & (F.size(r["entries"]) <= MOST_ENTRIES) & F.forall(r["entries"], good_entry)
    why = F.when(keys(text).isNull(), "not an object").when(~F.coalesce(known, F.lit(False)), "unknown field").when(~F.coalesce(bounded & plain, F.lit(False)), "value out of bounds")
    return raw.withColumn("refused", why).withColumn("report", F.when(why.isNull(), report))


def latest(reports: DataFrame, key: str = "device_id", seen: str = "seen", tie: str = "report_id") -> DataFrame:
    """The newest report of each device: later ones replace earlier ones whole."""
    newest = Window.partitionBy(key).orderBy(F.desc(seen), F.desc(tie))
    return reports.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upserted(stored: DataFrame, batch: DataFrame, key: str = "device_id", seen: str = "seen", tie: str = "report_id") -> DataFrame:
    """``stored`` with the reports of ``batch`` in place of older ones of the same device."""
    return latest(stored.unionByName(batch), key, seen, tie)


def report_of(entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """(device_id, report): the JSON report of each device from its audit entries (device_id, device_name, team, entry_id, at,
    kind, examined, transmitted, counts, total, duration_ms): the newest ``most`` in order of time, and nothing but these fields.

    Names are cut, and stand-ins take the place of empty ones.
    """
    newest = Window.partitionBy("device_id").orderBy(F.desc("at"), F.desc("entry_id"))
    kept = entries.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    cut = lambda c, other: F.coalesce(F.nullif(F.substring(F.coalesce(c, F.lit("")), 1, MOST_NAME), F.lit("")), F.lit(other))
    counts = F.transform("counts", lambda c: F.struct(c["category"].alias("category"), c["count"].alias("count")))
    entry = F.struct("at", "kind", "examined", "transmitted", counts.alias("counts"), "total", F.col("duration_ms").alias("durationMs"))
    grouped = kept.groupBy("device_id").agg(F.max_by("device_name", F.struct("at", "entry_id")).alias("_name"), F.max_by("team", F.struct("at", "entry_id")).alias("_team"), F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("_n"), entry.alias("e")))).alias("_e"))
    report = F.struct("device_id", cut(F.col("_name"), "Laptop").alias("device_name"), cut(F.col("_team"), "Unassigned").alias("team"), F.transform("_e", lambda x: x["e"]).alias("entries"))
    return grouped.select("device_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))
