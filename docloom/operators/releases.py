"""Releases, version entries and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import versions as V
from docloom.operators.places import least_ranges, running

TAGS_SHOWN = 100


def placed(versions: DataFrame) -> DataFrame:
    """Distinct versions with their place in the full order, from 1."""
    return running(versions.select("version"), [], [V.version_key(F.col("version"))], F.lit(1), "place")


def resolve_entries(releases: DataFrame, entries: DataFrame) -> DataFrame:
    """Releases with the first entry in file order whose list holds the version or whose range (least <= v < most) does."""
    own = F.struct("registry", "name").alias("g")
    named = F.col("registry").isNotNull() & F.col("name").isNotNull()
    e = entries.filter(named)
    listed = e.filter("versions is not null").select(own, F.explode("versions").alias("version"), "entry_ord").groupBy("g", "version").agg(F.min("entry_ord").alias("entry_ord"))
    ranges = e.filter("versions is null").select(own, F.col("entry_ord").alias("ord"), "min_version", "max_version")
    held = least_ranges(releases.filter(named).select(own, "version").distinct(), ranges).withColumnRenamed("ord", "entry_ord")
    first = listed.filter("version is not null").unionByName(held).groupBy("g", "version").agg(F.min("entry_ord").alias("entry_ord"))
    first = first.select(F.col("g.registry").alias("_registry"), F.col("g.name").alias("_name"), F.col("version").alias("_version"), "entry_ord")
    same = (F.col("registry") == F.col("_registry")) & (F.col("name") == F.col("_name")) & F.col("version").eqNullSafe(F.col("_version"))
    return releases.distinct().join(first, same).select(*releases.columns, "entry_ord")


def since(releases: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Releases of the last days; unknown dates pass."""
    return releases.filter(F.col("published_at").isNull() | (F.col("published_at") >= F.date_sub(as_of, days)))


def latest_patches(releases: DataFrame) -> DataFrame:
    """The highest version of each registry, name and major.minor; of equal ones the first by ord."""
    best = F.max_by(F.struct("version", "ord"), F.struct(V.dotted_key(F.col("version")), -F.col("ord")))
    return releases.groupBy("registry", "name", V.minor_of(F.col("version")).alias("minor")).agg(best.alias("b")).select("registry", "name", "minor", "b.version", "b.ord")


def newest(releases: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest versions of each package, with their rank."""
    order = W.partitionBy("registry", "name").orderBy(V.dotted_key(F.col("version")).desc(), "ord")
    return releases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def discover(releases: DataFrame, entries: DataFrame, definitions: DataFrame, days: int, as_of: Column, limit: int) -> DataFrame:
    """(registry, name, version, kind): feed releases through all filters, ``latest`` for unversioned definitions, listed
    versions where a registry has no feed, and unsupported ones."""
    stable = releases.filter(~V.is_prerelease(F.col("version")))
    chosen = newest(latest_patches(since(resolve_entries(stable, entries), days, as_of)), limit).select("registry", "name", "version", F.lit("release").alias("kind"))
    plain = definitions.filter("kind = 'unversioned'").select("registry", "name", F.lit("latest").alias("version"), F.lit("latest").alias("kind"))
    without = definitions.filter("kind = 'versioned' and not has_feed").select("registry", "name")
    listed = without.join(entries.filter("versions is not null"), ["registry", "name"]).select("registry", "name", F.explode("versions").alias("version")).distinct().withColumn("kind", F.lit("listed"))
    neither = without.join(listed, ["registry", "name"], "left_anti").select("registry", "name", F.lit(None).cast("string").alias("version"), F.lit("unsupported").alias("kind"))
    return chosen.unionByName(plain).unionByName(listed).unionByName(neither)


def latest_stable_tags(packages: DataFrame, tags: DataFrame) -> DataFrame:
    """(repo, package, tag): highest strict release among a package's own tags (any case), else among plain tags."""
    t = tags.select("repo", "tag", "ord", V.tag_parts(F.col("tag")).alias("p")).select("repo", "tag", "ord", F.lower("p.package").alias("tag_package"), V.strict_key(F.col("p.version")).alias("key"), F.col("p.package").isNotNull().alias("named"))
    joined = packages.join(t, "repo", "left").withColumn("own", F.col("named") & (F.col("tag_package") == F.lower("package")))
    has_own = F.coalesce(F.max("own"), F.lit(False))
    best = lambda cond: F.max_by("tag", F.when(cond & F.col("key").isNotNull(), F.struct("key", -F.col("ord"))))
    return joined.groupBy("repo", "package").agg(F.when(has_own, best(F.col("own"))).otherwise(best(~F.col("named"))).alias("tag"))


def listed_tags(tags: DataFrame, limit: int = TAGS_SHOWN) -> DataFrame:
    """The newest tags of each repository with their place: stable ones first, then prereleases, newest first."""
    pre = V.is_tagged_prerelease(V.tag_parts(F.col("tag")).getField("version"))
    new = tags.withColumn("prerelease", pre).withColumn("_n", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("ts"), "tag"))).filter(F.col("_n") <= limit)
    return new.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy("prerelease", F.desc("ts"), "tag"))).drop("_n")


def highest_in_ranges(entries: DataFrame, tags: DataFrame) -> DataFrame:
    """(registry, name, version): the highest version that tags of an entry's pattern give inside the entry's range."""
    own = F.struct("registry", "name", "repo", F.col("tag_pattern").alias("pattern")).alias("g")
    e = entries.select(own, "min_version", "max_version", F.lit(0).alias("ord"))
    asked = e.select("g", "g.repo", "g.pattern").distinct()
    found = asked.join(tags.select("repo", "tag"), "repo").select("g", V.version_in_tag(F.col("tag"), F.col("pattern")).alias("version")).filter("version is not null").distinct()
    return least_ranges(found, e).groupBy("g.registry", "g.name").agg(F.max_by("version", V.dotted_key(F.col("version"))).alias("version"))
