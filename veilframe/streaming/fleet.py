"""Fleet reports as a stream: each micro-batch replaces its devices' rows in a table of buckets.

The table is dealt into buckets by a hash of the device. A batch reads and writes only the buckets that its devices are in, as
a new version of these, and then a manifest, a row a bucket, that names each bucket's version; readers take the newest whole
manifest. So what a batch writes grows with the buckets it touches, a crash before the manifest leaves the table as
it was, and a batch that is applied twice, also after a lost checkpoint, changes nothing, as the newest report wins. Versions
that none of the last manifests names are deleted. One query writes a table at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.fleet import latest, upserted

#: Buckets of a table (fixed when it is first written), and manifests that stay readable.
BUCKETS, KEPT = 64, 3


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _listed(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions with a whole manifest, in order."""
    found = sorted(int(n.split("=")[1]) for n in _listed(spark, f"{path}/manifest") if n.startswith("version="))
    return [v for v in found if "_SUCCESS" in _listed(spark, f"{path}/manifest/version={v}")]


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").json(f"{path}/manifest/version={version}").collect()}  # a row a bucket


def _read(spark: SparkSession, path: str, named: dict[int, int], schema=None) -> DataFrame | None:
    parts = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(named.items())]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*parts) if parts else None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the newest manifest has it."""
    found = _versions(spark, path)
    return _read(spark, path, _manifest(spark, path, found[-1])) if found else None


def apply(batch: DataFrame, path: str, buckets: int = BUCKETS, kept: int = KEPT) -> None:
    """Replaces the rows of the batch's devices (device_id, seen, report_id, ...) where its reports are newer."""
    spark = batch.sparkSession
    before = _versions(spark, path)
    named = _manifest(spark, path, before[-1]) if before else {}
    version = before[-1] + 1 if before else 0
    new = latest(batch).withColumn("bucket", F.pmod(F.xxhash64("device_id"), F.lit(buckets)).cast("int")).persist()
    try:
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # as many as there are buckets
        if not touched:
            return
        old = _read(spark, path, {b: named[b] for b in touched if b in named}, batch.schema)
        rows = upserted(old, new.drop("bucket")) if old is not None else new.drop("bucket")
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("device_id"), F.lit(buckets)).cast("int")).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    finally:
        new.unpersist()
    named |= dict.fromkeys(touched, version)
    spark.createDataFrame(sorted(named.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/version={version}")
    _expire(spark, path, [*before, version], kept)


def _expire(spark: SparkSession, path: str, versions: list[int], kept: int) -> None:
    """Deletes all but the last manifests, and the versions of buckets that these don't name."""
    used = {(v, b) for n in versions[-kept:] for b, v in _manifest(spark, path, n).items()}
    for n in versions[:-kept]:
        files, place = _files(spark, f"{path}/manifest/version={n}")
        files.delete(place, True)
    for n in (int(x.split("=")[1]) for x in _listed(spark, f"{path}/data") if x.startswith("version=")):
        inside = [int(x.split("=")[1]) for x in _listed(spark, f"{path}/data/version={n}") if x.startswith("bucket=")]
        gone = [b for b in inside if (n, b) not in used]
        for part in [""] if len(gone) == len(inside) else [f"/bucket={b}" for b in gone]:
            files, place = _files(spark, f"{path}/data/version={n}{part}")
            files.delete(place, True)


def upsert_stream(reports: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts the upsert of a stream of (device_id, seen, report_id, ...) into ``path``."""
    return reports.writeStream.foreachBatch(lambda batch, _: apply(batch, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per type and window, with a watermark for late ones. An extension: reports themselves are replaced whole."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
