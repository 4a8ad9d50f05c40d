"""Package build: section copies, dense ids, metadata, results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.corpus import content_key
from docloom.operators.places import running

FEW_SECTIONS = 50


KEY = ["package_id", "file_ord", "section_ord"]


def unique_keys(sections: DataFrame) -> DataFrame:
    """(package_id, file_ord, section_ord) of the sections without later copies of their content in the package (titles
    don't count). Only hashes and places are grouped, with partial minima."""
    keyed = sections.select(*KEY, content_key(F.col("content")).alias("content_key"))
    return keyed.groupBy("package_id", "content_key").agg(F.min(F.struct("file_ord", "section_ord")).alias("first")).select("package_id", "first.*")


def unique_sections(sections: DataFrame) -> DataFrame:
    """Sections without later copies of their content in the package."""
    return sections.join(unique_keys(sections), KEY, "left_semi")


def dense_ids(keys: DataFrame) -> DataFrame:
    """(package_id, file_ord, section_ord, id): ids from 1 in (file, section) order of each package, numbered by the places
    alone."""
    return running(keys.select(*KEY), ["package_id"], [F.col("file_ord"), F.col("section_ord")], F.lit(1), "id")


def numbered(sections: DataFrame) -> DataFrame:
    """The sections with dense ids; they are numbered by their places alone and joined back once."""
    return sections.join(dense_ids(sections), KEY)


def unique_numbered(sections: DataFrame) -> DataFrame:
    """The first sections of each content with dense ids, content shuffled once."""
    return sections.join(dense_ids(unique_keys(sections)), KEY)


def meta_rows(packages: DataFrame) -> DataFrame:
    """(package_id, key, value) of name, version and the optional keys that are given."""
    keys = ["name", "version", "description", "source_url", "source_commit"]
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys))
    return packages.select("package_id", F.inline(pairs)).filter(F.col("key").isin("name", "version") | F.coalesce(F.col("value") != "", F.lit(False)))


def build_results(sections: DataFrame) -> DataFrame:
    """(package_id, section_count, total_tokens, low_docs)."""
    return sections.groupBy("package_id").agg(F.count("*").alias("section_count"), F.sum("tokens").alias("total_tokens")).withColumn("low_docs", F.col("section_count") < FEW_SECTIONS)


def build_status(targets: DataFrame, files: DataFrame, sections: DataFrame) -> DataFrame:
    """(package_id, n_files, n_sections, skipped, status): packages without files or sections are refused."""
    by_file = files.groupBy("package_id").agg(F.count("*").alias("n_files"), F.count_if(F.col("error").isNotNull()).alias("skipped"))
    by_section = sections.groupBy("package_id").agg(F.count("*").alias("n_sections"))
    out = targets.select("package_id").join(by_file, "package_id", "left").join(by_section, "package_id", "left").na.fill(0, ["n_files", "skipped", "n_sections"])
    return out.withColumn("status", F.when(F.col("n_files") == 0, "no files").when(F.col("n_sections") == 0, "no sections").otherwise("built"))
