"""Package catalog: (name, version, load_ord, size_bytes, section_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.versions import version_key
from docloom.operators.places import running


def key_of(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit("@"), version)


def upserted(loads: DataFrame) -> DataFrame:
    """The last load of each name and version."""
    rest = [c for c in loads.columns if c not in ("name", "version")]
    return loads.groupBy("name", "version").agg(F.max_by(F.struct(*rest), "load_ord").alias("r")).select("name", "version", "r.*")


def listing(catalog: DataFrame) -> DataFrame:
    """Rows with their place: names ascending as readers order them (accents and case decide last), versions highest first."""
    order = [F.collate(F.col("name"), "UNICODE"), F.col("name"), version_key(F.col("version")).desc()]
    return catalog.join(running(catalog.select("name", "version"), [], order, F.lit(1), "place"), ["name", "version"])


def totals(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("n_packages"), F.sum("size_bytes").alias("size_bytes"), F.sum("section_count").alias("section_count"))


def highest(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("name").agg(F.max_by("version", version_key(F.col("version"))).alias("version"))


def resolve(specs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(spec, name, version): an exact name@version, else the highest version of the bare name, else nulls."""
    exact = catalog.select(key_of(F.col("name"), F.col("version")).alias("spec"), F.col("name").alias("_n1"), F.col("version").alias("_v1"))
    top = highest(catalog).select(F.col("name").alias("spec"), F.col("name").alias("_n2"), F.col("version").alias("_v2"))
    return specs.join(exact, "spec", "left").join(top, "spec", "left").select("spec", F.coalesce("_n1", "_n2").alias("name"), F.coalesce("_v1", "_v2").alias("version"))


def spec_parts(spec: Column) -> Column:
    """(registry, name, version): registry before the first slash, version after the last @ that is not at the start."""
    registry = F.when(F.instr(spec, "/") > 1, F.substring_index(spec, "/", 1))
    rest = F.when(F.instr(spec, "/") > 1, F.regexp_replace(spec, "^[^/]*/", "")).otherwise(spec)
    named = rest.rlike("^.+@[^@]*$")
    return F.struct(registry.alias("registry"), F.when(named, F.regexp_extract(rest, "^(.+)@([^@]*)$", 1)).otherwise(rest).alias("name"), F.when(named, F.regexp_extract(rest, "^(.+)@([^@]*)$", 2)).alias("version"))


def allowed(catalog: DataFrame, specs: DataFrame) -> DataFrame:
    """Packages that a spec admits: a bare name all versions, a key one."""
    s = specs.select("spec").distinct()
    by_name = catalog.join(s, F.col("name") == F.col("spec"), "left_semi")
    by_key = catalog.join(s, key_of(F.col("name"), F.col("version")) == F.col("spec"), "left_semi")
    return by_name.unionByName(by_key).distinct()


def allowed_problems(specs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(spec, status, installed): ok, not installed, or a wrong version with the installed ones named."""
    parts = specs.select("spec", F.regexp_extract("spec", "^(.+)@([^@]*)$", 1).alias("n"), F.regexp_extract("spec", "^(.+)@([^@]*)$", 2).alias("v"))
    parts = parts.select("spec", F.when(F.col("n") == "", F.col("spec")).otherwise(F.col("n")).alias("name"), F.when(F.col("n") != "", F.col("v")).alias("wanted"))
    there = catalog.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("installed"))
    out = parts.join(there, "name", "left")
    status = F.when(F.col("installed").isNull(), "not installed").when(F.col("wanted").isNull() | F.array_contains("installed", F.col("wanted")), "ok").otherwise("wrong version")
    return out.select("spec", status.alias("status"), F.coalesce(F.array_join("installed", ", "), F.lit("")).alias("installed"))


def removals(specs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(spec, status, target): an exact key, the only version of a bare name, else ambiguous or missing."""
    keyed = catalog.select("name", key_of(F.col("name"), F.col("version")).alias("key"))
    exact = keyed.select(F.col("key").alias("spec"), F.col("key").alias("exact"))
    bare = keyed.groupBy(F.col("name").alias("spec")).agg(F.count("*").alias("n"), F.min("key").alias("only"))
    out = specs.join(exact, "spec", "left").join(bare, "spec", "left")
    status = F.when(F.col("exact").isNotNull() | (F.col("n") == 1), "remove").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return out.select("spec", status.alias("status"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("target"))


def lookup(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request_id, name, version): of the packages asked for (registry, name[, version]) the newest."""
    found = requests.select("request_id", "registry", "name", F.col("version").alias("_wanted")).join(catalog, ["registry", "name"]).filter(F.col("_wanted").isNull() | (F.col("_wanted") == F.col("version")))
    return found.groupBy("request_id", "name").agg(F.max_by("version", version_key(F.col("version"))).alias("version"))
