"""Stored archives: entries by their directories, dealt to many tasks, filters before anything is unpacked."""

import os
import random
import zipfile

from pyspark.sql import functions as F

from docloom.sources import files as sources


def packed(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("docs/", "")
        for name, content in entries:
            z.writestr(name, content)


def rows(df):
    return sorted((os.path.basename(r.archive), r.path, r.content) for r in df.collect())


def test_equals_whole_archives(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abé \n") for _ in range(rng.randrange(3000)))
    packed(tmp_path / "a b%20.zip", [(f"docs/{k} é.md", text()) for k in range(60)] + [("docs/1 é.md", "again"), ("docs/empty.md", "")])
    packed(tmp_path / "stored.zip", [("x.bin", b"\xff\xfe"), ("y.md", "Y")], zipfile.ZIP_STORED)
    packed(tmp_path / "none.zip", [])
    (tmp_path / "bad.zip").write_bytes(b"no")
    (tmp_path / "cut.zip").write_bytes((tmp_path / "stored.zip").read_bytes()[:-30])
    (tmp_path / "empty.zip").write_bytes(b"")
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path))
    got = rows(sources.read_archives(spark, str(tmp_path)))
    want = [r for r in rows(sources.entries_of(whole)) if r[1] != "docs/1 é.md"]
    assert [r for r in got if r[1] != "docs/1 é.md"] == want and len(want) == 62
    # A name that stands there twice has both contents; whole archives know the last one alone, twice.
    assert len([r for r in got if r[1] == "docs/1 é.md"]) == 2


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    packed(tmp_path / "big.zip", [(f"{k}.md", "x" * 500) for k in range(200)])
    found = sources.read_archives(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    by_task = [r["count"] for r in found.groupBy("task").count().collect()]
    assert len(by_task) == spark.sparkContext.defaultParallelism and max(by_task) < 120


def test_filters_come_before_unpacking(spark, tmp_path):
    packed(tmp_path / "a.zip", [("docs/a.md", "A" * 1000), ("docs/b.md", "B" * 1000)])
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        place = z.getinfo("docs/b.md").header_offset
    raw[place + 45 : place + 50] = b"\0" * 5  # b's own data
    (tmp_path / "a.zip").write_bytes(raw)
    wanted = F.col("path").endswith("/a.md")
    assert rows(sources.read_archives(spark, str(tmp_path), wanted)) == [("a.zip", "docs/a.md", "A" * 1000)]
    assert rows(sources.read_archives(spark, str(tmp_path))) == [("a.zip", "docs/a.md", "A" * 1000)]  # damaged entries give none
    assert rows(sources.read_archives(spark, str(tmp_path), F.col("size") > 5000)) == []
    plan = sources.listed_entries(spark, str(tmp_path)).filter(wanted)._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1]
