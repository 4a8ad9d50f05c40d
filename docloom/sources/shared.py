"""The folder that the driver and all executors share, and the bound of what goes to a Python worker at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Batches between Spark and its Python workers hold about so many bytes at most; rows are of very different lengths.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch where it is Spark's own default, so that a task's memory
    doesn't follow the longest rows."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key) == default:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; an own one only in local mode, where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4()}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows written as Parquet and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    store, place = _place(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(place)) if store.exists(place) else []


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Whether the folder could be given its new name, which must be free."""
    store, place = _place(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    return not store.exists(target) and store.rename(place, target)


def removed(spark: SparkSession, path: str) -> None:
    store, place = _place(spark, path)
    store.delete(place, True)
