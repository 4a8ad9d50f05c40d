"""A stored catalog with keyed upserts and removals.

Rows (name, version, load_ord and any others) lie below one path in parts chosen by a hash of (name, version), so that a
name with many versions fills many parts. A write reads the parts of its own keys alone, merges them with its rows and
writes them as new parts of a new segment; a manifest with one row for each part is published by one rename (see
``snapshots``). Parts of other keys are neither read nor written, readers see all of a write or nothing, and of two writes
that meet the second raises. Where parts have grown to twice ``PART_ROWS`` on average, the write deals all rows anew into more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import catalog
from docloom.sources import snapshots
from docloom.sources.shared import listed, new_folder, removed, stored

PART_ROWS, LISTED_PARTS = 250_000, 10_000
KEY = ["name", "version"]
MANIFEST = "bucket int, segment string, n_buckets int, n_rows long"


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(n_buckets)).cast("int")


def _live(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """(bucket, segment, n_buckets, n_rows) of the newest snapshot, or of an older one."""
    known = snapshots.versions(spark, path)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{version or known[-1]}")


def _rows(spark: SparkSession, path: str, live: DataFrame) -> DataFrame | None:
    """The rows of live parts; None where there are none."""
    parts = live.select(F.concat("segment", F.lit("-"), F.col("bucket").cast("string")).alias("part"))
    some = [r.part for r in parts.limit(LISTED_PARTS + 1).collect()]
    if not some or "rows" not in listed(spark, path):
        return None
    # A new column stands in newer parts alone, so the form is put together from the footers of the parts asked for.
    if len(some) <= LISTED_PARTS:
        read = spark.read.option("basePath", f"{path}/rows").option("mergeSchema", "true").parquet(*(f"{path}/rows/part={p}" for p in some))
        return read.drop("part")
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/rows").join(parts, "part", "left_semi").drop("part")


def read(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """All rows of the catalog's newest snapshot, or of an older one; an empty catalog has the key columns alone."""
    rows = _rows(spark, path, _live(spark, path, version))
    return spark.createDataFrame([], "name string, version string, load_ord long") if rows is None else rows


def _published(spark: SparkSession, path: str, keys: DataFrame, merged) -> str:
    """Replace the parts of the keys by what ``merged`` makes of their rows (None if there are none), and publish."""
    known = snapshots.versions(spark, path)
    live = _live(spark, path, known[-1] if known else None)
    figures = live.agg(F.max("n_buckets").alias("n"), F.sum("n_rows").alias("rows")).first()
    rows_after = (figures.rows or 0) + keys.count()
    n = figures.n or max(1, min(snapshots.MOST_PARTS, -(-rows_after // PART_ROWS)))
    anew = rows_after > 2 * PART_ROWS * n and n < snapshots.MOST_PARTS
    n_buckets = min(snapshots.MOST_PARTS, -(-rows_after // PART_ROWS)) if anew else n
    touched = live if anew else live.join(keys.select(_bucket(n).alias("bucket")).distinct(), "bucket", "left_semi")
    segment = snapshots.new_segment()
    rows = merged(_rows(spark, path, touched)).withColumn("_bucket", _bucket(n_buckets))
    part = F.concat(F.lit(segment + "-"), F.col("_bucket").cast("string"))
    out = rows.withColumn("part", part).repartition("part").drop("_bucket").sortWithinPartitions("part", *KEY)
    out.write.mode("append").partitionBy("part").parquet(f"{path}/rows")
    new = spark.createDataFrame([], MANIFEST)
    parts = [f"{path}/rows/{f}" for f in listed(spark, f"{path}/rows") if f.startswith(f"part={segment}-")]
    if parts:
        written = spark.read.option("basePath", f"{path}/rows").parquet(*parts)
        new = written.groupBy(F.element_at(F.split("part", "-"), -1).cast("int").alias("bucket")).agg(F.count("*").alias("n_rows"))
        new = new.select("bucket", F.lit(segment).alias("segment"), F.lit(n_buckets).alias("n_buckets"), "n_rows")
    rest = live.join(touched.select("bucket"), "bucket", "left_anti")
    return snapshots.commit(spark, path, rest.unionByName(new), known)


def upsert(loads: DataFrame, path: str) -> str:
    """Add or replace rows (name, version, load_ord, ...); of one key the highest load_ord stays. The snapshot's number.

    Rows without a name or a version are no packages and are left out. Columns that older rows lack are null there.
    """
    spark = loads.sparkSession
    work = new_folder(spark, "loads")
    new = stored(catalog.upserted(loads.filter("name IS NOT NULL AND version IS NOT NULL")), work)
    both = lambda old: new if old is None else catalog.upserted(old.unionByName(new, allowMissingColumns=True))
    number = _published(spark, path, new.select(*KEY), both)
    removed(spark, work)
    return number


def remove(keys: DataFrame, path: str) -> str:
    """Take the rows of the keys (name, version) out. The snapshot's number."""
    spark = keys.sparkSession
    work = new_folder(spark, "keys")
    gone = stored(keys.select(*KEY).distinct(), work)
    rest = lambda old: gone.limit(0) if old is None else old.join(gone, KEY, "left_anti")
    number = _published(spark, path, gone, rest)
    removed(spark, work)
    return number


def upserted_in_turns(loads: DataFrame, turns: int, path: str) -> DataFrame:
    """The catalog after the loads came in so many writes, in the order of load_ord by its remainder."""
    for k in range(turns):
        upsert(loads.filter(F.pmod("load_ord", F.lit(turns)) == k), path)
    return read(loads.sparkSession, path)
