"""Reading the supplied tables, and tables that a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes up to which a table is dealt anew, so that a file of one row group keeps all cores busy. Larger ones have groups enough.
SMALL_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: dealt anew if it is small, by the size that the scan states, else as it is."""
    spark = df.sparkSession
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(spark.sparkContext.defaultParallelism) if int(size) <= SMALL_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or for a local master without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_shared_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark._shared_dir = tempfile.mkdtemp(prefix="spark-veilframe-")
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for what several branches of a plan read: it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
