"""Definition files (YAML) as rows, and release feeds (JSON) of four shapes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEMA = (
    "name string, description string, repository string, source struct<type:string,url:string,ref:string,docs_path:string,exclude_paths:array<string>,lang:string>, "
    "versions array<struct<min_version:string,max_version:string,versions:array<string>,tag_pattern:string,source:struct<type:string,url:string,docs_path:string,exclude_paths:array<string>,lang:string>>>"
)


@F.pandas_udf(StringType())
def _json(texts: pd.Series) -> pd.Series:
    import yaml

    def one(t):
        try:
            return json.dumps(yaml.safe_load(t), default=str)
        except yaml.YAMLError:
            return None

    return texts.map(one)


def definitions_of(files: DataFrame) -> DataFrame:
    """(registry, path_name, d) of definition files (file, value); a scope folder is part of the name."""
    rule = "([^/]+)/((?:@[^/]+/)?[^/]+)\\.yaml$"
    return files.select(F.regexp_extract("file", rule, 1).alias("registry"), F.regexp_extract("file", rule, 2).alias("path_name"), F.from_json(_json("value"), SCHEMA).alias("d"))


def read_definitions(spark: SparkSession, root: str) -> DataFrame:
    """The same for all definition files below a folder."""
    return definitions_of(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yaml").text(root, wholetext=True).withColumn("file", F.input_file_name()))


def version_entries(definitions: DataFrame) -> DataFrame:
    """(registry, name, entry_ord, min_version, max_version, versions, tag_pattern, url)."""
    rows = definitions.select("registry", F.col("d.name").alias("name"), F.posexplode("d.versions").alias("entry_ord", "e"))
    return rows.select("registry", "name", "entry_ord", "e.min_version", "e.max_version", "e.versions", "e.tag_pattern", F.col("e.source.url").alias("url"))


def releases_of_feeds(feeds: DataFrame) -> DataFrame:
    """(registry, name, version, published_at) of feeds (registry, name, payload)."""
    keep = ["registry", "name"]
    npm = feeds.filter("registry = 'npm'").withColumn("p", F.from_json("payload", "versions map<string,string>, time map<string,string>"))
    npm = npm.select(*keep, F.explode(F.map_keys("p.versions")).alias("version"), F.col("p.time").alias("t")).select(*keep, "version", F.to_timestamp(F.try_element_at("t", F.col("version"))).alias("published_at"))
    pip = feeds.filter("registry = 'pip'").withColumn("p", F.from_json("payload", "releases map<string,array<struct<upload_time_iso_8601:string>>>"))
    pip = pip.select(*keep, F.explode("p.releases").alias("version", "files")).select(*keep, "version", F.to_timestamp(F.get("files", F.lit(0)).getField("upload_time_iso_8601")).alias("published_at"))
    maven = feeds.filter("registry = 'maven'").withColumn("p", F.from_json("payload", "response struct<docs:array<struct<v:string,timestamp:bigint>>>"))
    maven = maven.select(*keep, F.explode("p.response.docs").alias("d")).select(*keep, F.col("d.v").alias("version"), F.timestamp_millis("d.timestamp").alias("published_at"))
    hexed = feeds.filter("registry = 'hex'").withColumn("p", F.from_json("payload", "releases array<struct<version:string,inserted_at:string>>"))
    hexed = hexed.select(*keep, F.explode("p.releases").alias("d")).select(*keep, "d.version", F.to_timestamp("d.inserted_at").alias("published_at"))
    return npm.unionByName(pip).unionByName(maven).unionByName(hexed)
