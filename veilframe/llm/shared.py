"""Reading tables and cutting lineage, for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Taken from ``spark.checkpoint.dir``. Only where that is unset and driver and tasks are one process, as in
    local tests, a temporary folder stands in for it; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_veilframe_dir", None) or tempfile.mkdtemp(prefix="spark-veilframe-")
        spark._veilframe_dir = found
    return found.rstrip("/")


#: Paths of the tables that ``written`` made, in order, by application.
made: dict[str, list[str]] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made.setdefault(spark.sparkContext.applicationId, []).append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._veilframe_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_veilframe_path", None)
    if path:
        _delete(df.sparkSession, path)


def mark(spark: SparkSession) -> int:
    """A place in the list of written tables, for ``discard_since``."""
    return len(made.get(spark.sparkContext.applicationId, ()))


def discard_since(spark: SparkSession, place: int, but: DataFrame) -> None:
    """Delete all tables written after ``place`` but one, when that one holds the result and nothing reads the others."""
    paths = made.get(spark.sparkContext.applicationId, [])
    keep = getattr(but, "_veilframe_path", None)
    for path in paths[place:]:
        if path != keep:
            _delete(spark, path)
    paths[place:] = [keep] if keep in paths[place:] else []
