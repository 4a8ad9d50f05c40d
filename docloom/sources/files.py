"""Documentation trees and ZIP archives as files (path, content)."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.shared import new_folder, stored


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below a folder; what can't be read is skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    base = root.split("://", 1)[-1].rstrip("/").lstrip("/").removeprefix("file:")
    return raw.select(F.regexp_replace("path", f"^.*?\\Q{base}\\E/", "").alias("path"), F.decode("content", "UTF-8").alias("content"))


#: Entries of an archive leave a task in batches of about so many characters.
BATCH_CHARS = 4_000_000


def entries_of(archives: DataFrame) -> DataFrame:
    """(archive, path, content) of all text entries of ZIP archives (path, content as bytes); broken archives give none."""

    def opened(path: str, content: bytes) -> Iterator[tuple[str, str, str]]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield path, i.filename, z.read(i).decode("utf-8", "replace")
        except (zipfile.BadZipFile, TypeError, EOFError):
            return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        frame = lambda: pd.DataFrame(rows, columns=["archive", "path", "content"], dtype=object)
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                for row in opened(path, content):
                    rows.append(row)
                    size += len(row[2])
                    if size > BATCH_CHARS:
                        yield frame()
                        rows, size = [], 0
        yield frame()

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, content string")


ENTRY = "archive string, path string, place long, packed long, size long, method int, crc long"
#: Entries that one task reads have about so many unpacked bytes, if no single entry is larger.
TASK_BYTES = 64 << 20


def _opened(archive: str):
    return open(archive.removeprefix("file:"), "rb")


def _directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries that archives' own directories list; the files' ends are read alone."""
    for batch in batches:
        for archive in batch.path:
            try:
                with _opened(archive) as f, zipfile.ZipFile(f) as z:
                    rows = [(archive, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in z.infolist() if not i.is_dir() and not i.flag_bits & 1]
            except (zipfile.BadZipFile, EOFError, ValueError):
                continue
            yield pd.DataFrame(rows, columns=["archive", "path", "place", "packed", "size", "method", "crc"])


def _unpacked(f: BinaryIO, row) -> bytes | None:
    """One entry's bytes from its place; None if it is damaged or packed by a method other than deflate."""
    f.seek(row.place)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        return None
    f.seek(int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), 1)
    data = f.read(row.packed)
    try:
        data = data if row.method == zipfile.ZIP_STORED else zlib.decompress(data, -zlib.MAX_WBITS) if row.method == zipfile.ZIP_DEFLATED else b""
    except zlib.error:
        return None
    return data if len(data) == row.size and zlib.crc32(data) == row.crc else None


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frame = lambda rows: pd.DataFrame(rows, columns=["archive", "path", "content"], dtype=object)
    for batch in batches:
        for archive, entries in batch.groupby("archive", sort=False):
            rows, size = [], 0
            with _opened(archive) as f:
                for entry in entries.itertuples():
                    data = _unpacked(f, entry)
                    if data is None:
                        continue
                    rows.append((archive, entry.path, data.decode("utf-8", "replace")))
                    size += len(data)
                    if size > BATCH_CHARS:
                        yield frame(rows)
                        rows, size = [], 0
            yield frame(rows)


def listed_entries(spark: SparkSession, root: str) -> DataFrame:
    """(archive, path, place, packed, size, method, crc) of the entries of all ZIP archives below a folder, by their
    directories alone; broken archives and encrypted entries give none. The folder is one that every executor can open."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return found.select("path").mapInPandas(_directories, ENTRY)


def entry_contents(entries: DataFrame) -> DataFrame:
    """(archive, path, content) of listed entries, which are dealt to tasks one by one, so that a large archive is read by
    many of them, each by the entries' places; damaged entries are left out. What was filtered out before isn't read."""
    spark = entries.sparkSession
    listed = stored(entries, new_folder(spark, "entries"))
    size = listed.agg(F.sum("size")).first()[0] or 0
    # Rows are small and what they stand for isn't, so the number of tasks is given, not left to the rows' sizes.
    n = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    dealt = listed.repartition(n, "archive", "path", "place").sortWithinPartitions("archive", "place")
    return dealt.mapInPandas(_contents, "archive string, path string, content string")


def read_archives(spark: SparkSession, root: str, wanted: Column | None = None) -> DataFrame:
    """(archive, path, content) of the text entries of the ZIP archives below a folder, of those ``wanted`` (a condition on
    archive, path and size) alone if it is given.

    Folders of a file system that executors open themselves are read by places. Others come through Spark's reader, an
    archive in a task.
    """
    if "://" in root and not root.startswith("file:"):
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
        found = entries_of(whole).withColumn("size", F.octet_length("content"))
        return (found if wanted is None else found.filter(wanted)).drop("size")
    found = listed_entries(spark, root)
    return entry_contents(found if wanted is None else found.filter(wanted))
