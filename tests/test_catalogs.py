import glob
import random

import pytest

from docloom.jobs import catalogs
from docloom.operators import catalog
from docloom.sources import snapshots

FORM = "name string, version string, load_ord long, size_bytes long"


def loads(spark, rows):
    return spark.createDataFrame(rows, FORM)


def state(df):
    return sorted((r.name, r.version, r.load_ord, r.size_bytes) for r in df.collect())


def parts(path):
    return set(glob.glob(f"{path}/rows/part=*"))


def test_writes_equal_one_upsert_and_touch_their_parts_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogs, "PART_ROWS", 10)
    path, rng = str(tmp_path), random.Random(5)
    rows = [(rng.choice(["hot", "hot", f"n{k % 40}"]), f"1.{rng.randint(0, 80)}.0", k, k * 7) for k in range(300)]
    catalogs.upsert(loads(spark, rows[:200]), path)
    first = parts(path)
    assert len(first) > 5
    catalogs.upsert(loads(spark, rows[200:202]), path)
    second = parts(path) - first
    assert 1 <= len(second) <= 2 and first <= parts(path)
    catalogs.upsert(loads(spark, rows[202:]), path)
    assert state(catalogs.read(spark, path)) == state(catalog.upserted(loads(spark, rows)))
    assert state(catalogs.read(spark, path, "000000000000")) == state(catalog.upserted(loads(spark, rows[:200])))


def test_removal_older_loads_nulls_and_new_columns(spark, tmp_path):
    path = str(tmp_path)
    assert catalogs.read(spark, path).count() == 0
    catalogs.upsert(loads(spark, []), path)
    catalogs.remove(spark.createDataFrame([("a", "1")], "name string, version string"), path)
    assert catalogs.read(spark, path).count() == 0
    catalogs.upsert(loads(spark, [("a", "1", 5, 1), ("b", "1", 5, 2), (None, "1", 6, 3), ("a", None, 6, 3)]), path)
    catalogs.upsert(loads(spark, [("a", "1", 4, 9)]), path)
    assert state(catalogs.read(spark, path)) == [("a", "1", 5, 1), ("b", "1", 5, 2)]
    catalogs.upsert(spark.createDataFrame([("c", "1", 7, "MIT")], "name string, version string, load_ord long, license string"), path)
    assert sorted((r.name, r.size_bytes, r.license) for r in catalogs.read(spark, path).collect()) == [("a", 1, None), ("b", 2, None), ("c", None, "MIT")]
    catalogs.remove(spark.createDataFrame([("a", "1"), ("x", "1")], "name string, version string"), path)
    assert [r.name for r in catalogs.read(spark, path).orderBy("name").collect()] == ["b", "c"]


def test_a_write_that_fails_leaves_the_catalog(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    catalogs.upsert(loads(spark, [("a", "1", 1, 1)]), path)
    monkeypatch.setattr(snapshots, "renamed", lambda *_: False)
    with pytest.raises(RuntimeError):
        catalogs.upsert(loads(spark, [("a", "1", 2, 2)]), path)
    assert state(catalogs.read(spark, path)) == [("a", "1", 1, 1)]
