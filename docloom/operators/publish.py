"""Publish planning and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpublished(discovered: DataFrame, published: DataFrame) -> DataFrame:
    return discovered.join(published.select("registry", "name", "version"), ["registry", "name", "version"], "left_anti")


def changed_sources(definitions: DataFrame, published: DataFrame, heads: DataFrame) -> DataFrame:
    """(registry, name, action): unversioned definitions are skipped where a git source's published commit is current."""
    out = definitions.join(published.select("registry", "name", F.col("source_commit").alias("_published")), ["registry", "name"], "left").join(heads.select("registry", "name", F.col("commit").alias("_head")), ["registry", "name"], "left")
    same = (F.col("source_type") == "git") & F.col("_published").isNotNull() & F.col("_published").eqNullSafe(F.col("_head"))
    return out.select("registry", "name", F.when(same, "skip").otherwise("build").alias("action"))


# Messages of git that name a network failure, and those that name a missing ref.
TRANSIENT = ["could ?not resolve host", "failed to connect", "connection (timed out|reset|refused)", "operation timed out", "gnutls recv error", "early eof", "remote end hung up unexpectedly", "rpc failed", "returned error: (429|5[0-9][0-9])"]
MISSING_REF = ["remote branch .* not found in upstream", "could not find remote (branch|ref)", "(pathspec|reference) .* did not match"]


def error_class(message: Column) -> Column:
    """transient, missing ref or other."""
    has = lambda patterns: message.rlike("(?i)" + "|".join(patterns))
    return F.when(has(MISSING_REF), "missing ref").when(has(TRANSIENT), "transient").otherwise("other")


def run_summary(results: DataFrame) -> DataFrame:
    """(status, n): succeeded, skipped (a missing ref counts so) and failed."""
    status = F.when(F.col("error").isNull(), F.when(F.col("skipped"), "skipped").otherwise("succeeded")).when(error_class(F.col("error")) == "missing ref", "skipped").otherwise("failed")
    return results.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def failures(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNotNull() & (error_class(F.col("error")) != "missing ref")).select("registry", "name", "version", "error")


def build_report(results: DataFrame) -> DataFrame:
    """Totals by registry: passed, failed, sections, tokens."""
    ok = F.col("error").isNull() & (F.col("sections") > 0)
    return results.groupBy("registry").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("sections")).otherwise(0)).alias("sections"), F.sum(F.when(ok, F.col("tokens")).otherwise(0)).alias("tokens"))


def definition_errors(definitions: DataFrame) -> DataFrame:
    """(registry, name, errors): exactly one of versions and source, a list that isn't empty, a name that is its path's."""
    both = F.col("versions").isNotNull() & F.col("has_source")
    neither = F.col("versions").isNull() & ~F.col("has_source")
    checks = F.array(
        F.when(both, "both versions and source"), F.when(neither, "neither versions nor source"),
        F.when(F.size("versions") == 0, "empty versions"), F.when(F.replace("name", F.lit(":"), F.lit("_")) != F.col("path_name"), "name differs from path"),
    )
    return definitions.select("registry", "name", F.array_compact(checks).alias("errors"))


def coverage(definitions: DataFrame, entries: DataFrame) -> DataFrame:
    """(registry, name, ranges): the entries' ranges in order, or unversioned."""
    text = F.when(F.col("versions").isNotNull(), F.array_join("versions", ", ")).otherwise(F.concat(F.lit(">="), F.col("min_version"), F.coalesce(F.concat(F.lit(" <"), F.col("max_version")), F.lit(""))))
    listed = entries.select("registry", "name", F.struct("entry_ord", text.alias("t")).alias("e")).groupBy("registry", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e.t), "; ").alias("ranges"))
    return definitions.select("registry", "name").join(listed, ["registry", "name"], "left").select("registry", "name", F.coalesce("ranges", F.lit("unversioned")).alias("ranges"))
