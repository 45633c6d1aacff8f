"""What devices keep as evidence: transmissions within a byte budget, proofs of scans, audits as shareable JSON, latencies.

Each store is windows or groups over one device's entries, of which only the newest are kept; entries of different
devices never meet. Null texts and frames have no bytes. Ties in time are ordered by the entry's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.coverage import MOST_STOPS

# Fixed values.
MOST_SCREENS, QUOTA = MOST_STOPS, 5 << 20


def omitted_frame(bytes_) -> F.Column:
    """What stands for a picture where a transmission is shown as text."""
    return F.concat(F.lit("<redacted image, "), F.floor(bytes_ / 1024 + 0.5).cast("string"), F.lit("KB, omitted here for length>"))


def kept_evidence(sent: DataFrame, budget: int = QUOTA, cap: int = 1, device: str = "device_id") -> DataFrame:
    """(device_id, entry_id, at, json, frame, frame_bytes, frame_note) of the newest ``cap`` transmissions (device_id, entry_id, at, json, frame) of each device.

    The texts always stay. Frames stay from the newest on, as long as they and all kept texts fit in ``budget`` bytes; the
    first that does not fit, and all older ones, are dropped, and only their size is told.
    """
    newest = Window.partitionBy(device).orderBy(F.desc("at"), F.desc("entry_id"))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    rows = sent.withColumns({"_n": F.row_number().over(newest), "frame_bytes": size("frame"), "_text": size("json")}).where(F.col("_n") <= max(1, cap))
    texts = F.sum("_text").over(Window.partitionBy(device))
    frames = F.sum("frame_bytes").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = rows.withColumn("_fits", texts + frames <= budget)
    return kept.select(device, "entry_id", "at", "json", F.when(F.col("_fits"), F.col("frame")).alias("frame"), "frame_bytes", omitted_frame(F.col("frame_bytes")).alias("frame_note"))


def kept_proofs(screens: DataFrame, most: int = MOST_SCREENS, device: str = "device_id") -> DataFrame:
    """The screens (device_id, proof_id, at, stop, painted, ...) of each device's newest proof: the first ``most`` that could be painted.

    ``omitted`` counts those that could not; a raw screen never takes their place. A proof of none leaves no rows.
    """
    whole = Window.partitionBy(device, "proof_id")
    last = Window.partitionBy(device).orderBy(F.desc("_at"), F.desc("proof_id"))
    rows = screens.withColumns({"_at": F.max("at").over(whole), "omitted": F.count_if(~F.coalesce("painted", F.lit(False))).over(whole)})
    newest = rows.withColumn("_p", F.dense_rank().over(last)).where("_p = 1 and painted")
    placed = newest.withColumn("_s", F.row_number().over(whole.orderBy("stop")))
    return placed.where(F.col("_s") <= most).drop("_at", "_p", "_s")


def audit_json(entries: DataFrame, now_ms: int, fields: tuple[str, ...] = ("kind", "transmitted", "total", "durationMs"), device: str = "device_id", note: str = "categories, counts and times only") -> DataFrame:
    """(device_id, json): each device's entries (at in milliseconds, ``fields``) as a document that holds nothing else, newest first."""
    moment = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    entry = F.struct(moment(F.col("at")).alias("at"), *fields)
    listed = entries.groupBy(device).agg(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("_o"), (-F.col("entry_id")).alias("_t"), entry.alias("e")))).alias("_e"))
    body = F.struct(moment(F.lit(now_ms)).alias("generatedAt"), F.lit(note).alias("note"), F.transform("_e", lambda x: x["e"]).alias("entries"))
    return listed.select(device, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


#: Shares of a group's rows by which an exact quantile is bracketed: the sketch's error, several times over.
_MARGIN = 5


def latency(steps: DataFrame, *keys: str, quantiles: tuple[float, ...] = (0.5, 0.95), accuracy: int = 10_000) -> DataFrame:
    """(keys, n, least, most, mean, q50, q95) of ``ms``. A quantile is the least value with that share at or below it, exactly.

    A mergeable sketch brackets each quantile within some rows in ``accuracy``; what lies below is counted by value, and only the
    different values between are put in order. Where the bracket misses the rank, the whole group counts as the bracket.
    """
    timed = steps.where("ms is not null").withColumn("_k", F.struct(F.lit(1).alias("_"), *keys))
    off = _MARGIN / accuracy
    shares = [min(1.0, max(0.0, q + side * off)) for q in quantiles for side in (-1, 1)]
    told = timed.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.avg("ms").alias("mean"), F.approx_percentile("ms", shares, accuracy).alias("_q"))
    rank = lambda q: F.greatest(F.ceil(F.col("n") * F.lit(q)).cast("long"), F.lit(1).cast("long"))
    asked = told.select("_k", "least", "most", F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), rank(q).alias("_rank"), F.col("_q")[2 * i].alias("_lo"), F.col("_q")[2 * i + 1].alias("_hi")) for i, q in enumerate(quantiles)])))
    counted = timed.groupBy("_k", "ms").agg(F.count(F.lit(1)).alias("_c"))
    share = lambda holds: F.coalesce(F.sum(F.when(holds, F.col("_c"))), F.lit(0).cast("long"))
    sums = counted.join(asked, "_k").groupBy("_k", "_i", "_rank", "least", "most", "_lo", "_hi").agg(share(F.col("ms") < F.col("_lo")).alias("_below"), share(F.col("ms") <= F.col("_hi")).alias("_upto"))
    held = (F.col("_rank") > F.col("_below")) & (F.col("_rank") <= F.col("_upto"))
    ends = sums.select("_k", "_i", "_rank", F.when(held, F.col("_lo")).otherwise(F.col("least")).alias("_lo"), F.when(held, F.col("_hi")).otherwise(F.col("most")).alias("_hi"), F.when(held, F.col("_below")).otherwise(0).alias("_below"))
    between = counted.join(ends, "_k").where(F.col("ms").between(F.col("_lo"), F.col("_hi")))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy("_k", "_i").orderBy("ms"))
    found = between.withColumn("_n", upto).where("_n >= _rank").groupBy("_k").agg(*[F.min(F.when(F.col("_i") == i, F.col("ms"))).alias(f"q{round(q * 100)}") for i, q in enumerate(quantiles)])
    return told.join(found, "_k").select(*[F.col("_k")[k].alias(k) for k in keys], "n", "least", "most", "mean", *[f"q{round(q * 100)}" for q in quantiles])
