"""Readers of the given tables and small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.shared import bounded_batches, new_folder, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in the shared folder."""
    shared_dir(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, purpose: str, level: int = 3) -> DataFrame:
    """The rows as a compressed Parquet table in the shared folder, read again."""
    path = new_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(df: DataFrame) -> Column:
    """All columns as one struct, so that columns of any name can't clash with those of an operator; ``unboxed`` opens it."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def unboxed(df: DataFrame, **changed: Column) -> DataFrame:
    """The columns of the struct ``row``, some of them replaced."""
    names = df.schema["row"].dataType.names
    return df.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in names))


def crc_bucket(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``new_folder`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
