import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import catalog, places, releases


def compare(a, b):
    """-1, 0, 1 by the first segment that differs, None where a segment is no number there."""
    if a is None or b is None:
        return None
    x, y = a.split("."), b.split(".")
    for i in range(max(len(x), len(y))):
        s, t = (z[i] if i < len(z) else "0" for z in (x, y))
        if not all(z == "" or (z.isascii() and z.isdigit()) for z in (s, t)):
            return None
        if int(s or 0) != int(t or 0):
            return -1 if int(s or 0) < int(t or 0) else 1
    return 0


def holds(version, low, high):
    return compare(version, low) != -1 and compare(version, high) not in (0, 1)


def some_version(rng):
    return ".".join(str(rng.choice([0, 0, 1, 2, 3, 9, 10, 11, 10**25])) for _ in range(rng.randint(1, 4)))


@pytest.mark.parametrize("seed", [1, 2])
def test_least_ranges_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    odd = ["1.x", "2.1-rc", "", "1..2", "latest", "01.2"]
    bound = lambda: rng.choice([None, some_version(rng), some_version(rng), some_version(rng), rng.choice(odd)])
    groups = ["a", "b", "lonely", "empty"]
    ranges = [(rng.choice("ab"), rng.randint(0, 40), bound(), bound()) for _ in range(60)] + [("lonely", 3, None, None)]
    ranges += ranges[:5]
    points = {(g, v) for g in groups for v in [None, *odd, *(some_version(rng) for _ in range(60))]}
    want = {}
    for g, v in points:
        fits = [o for h, o, low, high in ranges if h == g and holds(v, low, high)]
        if fits:
            want[g, v] = min(fits)
    p = spark.createDataFrame(list(points), "name string, version string").select(F.struct("name").alias("g"), "version")
    r = spark.createDataFrame(ranges, "name string, ord long, min_version string, max_version string").select(F.struct("name").alias("g"), "ord", "min_version", "max_version")
    got = {(x.g.name, x.version): x.ord for x in places.least_ranges(p, r).collect()}
    assert got == want


def test_many_ranges_of_one_name(spark):
    """3,000 ranges and 3,000 versions of one name, of which 4.5 million pairs fit."""
    n = 3000
    r = spark.range(n).select(F.lit("npm").alias("registry"), F.lit("x").alias("name"), F.col("id").alias("entry_ord"), F.concat(F.lit("1."), F.lit(n) - F.col("id")).alias("min_version"), F.lit(None).cast("string").alias("max_version"), F.lit(None).cast("array<string>").alias("versions"))
    v = spark.range(n).select(F.lit("npm").alias("registry"), F.lit("x").alias("name"), F.concat(F.lit("1."), F.col("id")).alias("version"))
    got = {x.version: x.entry_ord for x in releases.resolve_entries(v, r).collect()}
    assert got == {f"1.{k}": n - k for k in range(1, n)}


def test_entries_of_nulls_lists_and_empty_tables(spark):
    kind = "registry string, name string, entry_ord int, min_version string, max_version string, versions array<string>"
    entries = spark.createDataFrame([("r", "n", 4, None, "2.0", None), ("r", "n", 1, None, None, ["7.1", None]), (None, "n", 0, None, None, None)], kind)
    rows = spark.createDataFrame([("r", "n", "1.9", "e"), ("r", "n", "2", "e"), ("r", "n", "7.1", "e"), ("r", "n", None, "e"), (None, "n", "1", "e"), ("r", "n", "1.9", "e")], "registry string, name string, version string, g string")
    got = sorted((x.version or "", x.g, x.entry_ord) for x in releases.resolve_entries(rows, entries).collect())
    assert got == [("", "e", 4), ("1.9", "e", 4), ("7.1", "e", 1)]
    assert releases.resolve_entries(rows.limit(0), entries).count() == releases.resolve_entries(rows, entries.limit(0)).count() == 0


def test_names_in_the_order_of_readers(spark):
    names = ["_x", "-x", "@s/y", "1a", "a", "A", "á", "b", "B", "Zebra", "zebras"]
    rows = [(n, v) for n in reversed(names) for v in ("1.10.0", "1.9.0")]
    got = catalog.listing(spark.createDataFrame(rows, "name string, version string")).orderBy("place").collect()
    assert [(x.name, x.version) for x in got] == [(n, v) for n in names for v in ("1.10.0", "1.9.0")]
    assert [x.place for x in got] == list(range(1, len(rows) + 1))


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 50), rng.randint(-2, 5), k) for k in range(400) for g in ("hot", rng.choice("abc"))]
    got = places.running(spark.createDataFrame(rows, "g string, at int, w int, id int").repartition(7), ["g"], [F.col("at").desc(), F.col("id")], F.col("w"), "sum").collect()
    assert len(got) == len(rows)
    want, last = {}, {}
    for g, at, w, k in sorted(rows, key=lambda r: (-r[1], r[3])):
        last[g] = last.get(g, 0) + w
        want[g, at, w, k] = last[g]
    assert all(want[x.g, x["at"], x.w, x.id] == x["sum"] for x in got)
