"""Places in an order and the ranges that hold them, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import versions as V
from docloom.sources.shared import new_folder, stored


def running(rows: DataFrame, group: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """The rows with the sum of weights of their group from its first row in order to themselves.

    The rows are dealt into ranges of the order and stored; sums by group and range give offsets, a window adds inside a
    range. Only groups of one range, however large the table, meet in one task.
    """
    dealt = rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, new_folder(rows.sparkSession, "places"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy(*group, "_part").agg(F.sum(weight).alias("_n")).select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.sum(weight).over(W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return dealt.withColumn("_inside", inside).join(offsets, [*group, "_part"]).withColumn(name, F.col("_offset") + F.col("_inside")).drop("_part", "_inside", "_offset")


def least_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(g, version, ord): for each of the distinct points (g, version) the least ord of its group's ranges
    (g, ord, min_version, max_version) with least <= version < most; an open end holds all, points in no range are left out.

    g is never null. A point's place is the number of bounds up to it, so that a range is a run of places. Runs are cut into
    the nodes of a binary tree over places, of which only the least ord stays; a point looks at the nodes above it, one a
    level. Versions and bounds that are no dotted numbers have no place and are compared pair by pair; two versions that
    differ first where one has no number fit each other.
    """
    known = ranges.select("g", "ord", "min_version", "max_version", V.dotted_key(F.col("min_version")).alias("least"), V.dotted_key(F.col("max_version")).alias("most"))
    odd = (F.col("min_version").isNotNull() & F.col("least").isNull()) | (F.col("max_version").isNotNull() & F.col("most").isNull())
    plain = known.filter(~odd).withColumn("id", F.xxhash64("g", "ord", "min_version", "max_version"))
    keyed = points.select("g", "version", V.dotted_key(F.col("version")).alias("key"))
    placed = keyed.filter("key is not null")

    ends = plain.select("g", "ord", "id", F.explode(F.array(F.struct(F.col("least").alias("key"), F.lit(0).alias("side")), F.struct(F.col("most").alias("key"), F.lit(1).alias("side")))).alias("e"))
    ends = ends.select("g", "e.key", F.lit(1).alias("bound"), "ord", "id", "e.side", F.lit(None).cast("string").alias("version")).filter("key is not null").distinct()
    at = placed.select("g", "key", F.lit(0).alias("bound"), F.lit(None).cast(ranges.schema["ord"].dataType).alias("ord"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("side"), "version")
    order = [F.col("key"), F.col("bound").desc(), F.col("ord"), F.col("id"), F.col("side"), F.col("version")]
    both = running(ends.unionByName(at), ["g"], order, F.col("bound"), "place")

    n = both.groupBy("g").agg(F.sum("bound").alias("n")).select("g", "n", F.length(F.bin("n")).alias("levels"))
    of = both.filter("bound = 1").groupBy("g", "id").agg(F.max(F.expr("IF(side = 0, place, NULL)")).alias("low"), F.max(F.expr("IF(side = 1, place, NULL)")).alias("high"))
    runs = plain.select("g", "id", "ord").distinct().join(of, ["g", "id"], "left").join(n, "g")
    runs = runs.select("g", "ord", "levels", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.col("n") + 1).alias("high"))
    left, right = "(-shiftright(-low, k))", "shiftright(high, k)"
    node = lambda x, of: f"IF({left} < {right} AND {x} % 2 = 1, struct(k AS level, {of} AS node), NULL)"
    nodes = F.expr(f"flatten(transform(sequence(0, levels), k -> filter(array({node(left, left)}, {node(right, right + ' - 1')}), x -> x IS NOT NULL)))")
    tree = runs.select("g", "ord", F.explode(nodes).alias("t")).groupBy("g", "t.level", "t.node").agg(F.min("ord").alias("ord"))
    above = both.filter("bound = 0").join(n, "g").select("g", "version", F.explode(F.expr("transform(sequence(0, levels), k -> struct(k AS level, shiftright(place, k) AS node))")).alias("t"))
    found = above.select("g", "version", "t.*").join(tree, ["g", "level", "node"]).select("g", "version", "ord")

    fits = ~V.dotted_below(F.col("version"), F.col("min_version")) & ~V.dotted_reaches(F.col("version"), F.col("max_version"))
    pairs = keyed.filter("key is null").join(known, "g").unionByName(placed.join(known.filter(odd), "g")).filter(fits).select("g", "version", "ord")
    return found.unionByName(pairs).groupBy("g", "version").agg(F.min("ord").alias("ord"))
