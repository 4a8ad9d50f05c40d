"""Corpus-shaped tables derived from the given ones, each as SQL expressions that Spark and the check's engine share."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FILES = {
    "package_id": "coalesce(source, '')",
    "file_ord": "doc_id",
    "path": "CASE doc_id % 10 WHEN 0 THEN 'docs/' WHEN 1 THEN 'docs/' || lang || '/' WHEN 2 THEN 'docs/tests/' WHEN 3 THEN '.github/' WHEN 4 THEN 'Docs/guide/' WHEN 5 THEN 'docs/zh-CN/' || lang || '/' WHEN 6 THEN 'documentation/Examples/' ELSE 'docs/api/' END"
    " || CASE doc_id % 7 WHEN 0 THEN 'CHANGELOG' WHEN 1 THEN 'page.test' WHEN 2 THEN '.hidden' WHEN 3 THEN 'License' ELSE 'page' || CAST(doc_id AS STRING) END"
    " || CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.MDX' WHEN 2 THEN '.rst' WHEN 3 THEN '.txt' WHEN 4 THEN '.html' ELSE '.adoc' END",
    "content": "text",
    "lang": "CASE doc_id % 4 WHEN 0 THEN 'all' WHEN 1 THEN lang WHEN 2 THEN 'en' END",
}
#: Marked-up text: component tags, blank runs, links and fences around the documents' own words.
MARKED = {
    "doc_id": "doc_id",
    "title": "CASE doc_id % 5 WHEN 0 THEN 'TOC' WHEN 1 THEN 'Table of Contents of it' WHEN 2 THEN 'index' ELSE 'Guide' END",
    "content": "CASE doc_id % 4 WHEN 0 THEN '<AppOnly>' || text || '</AppOnly>' || chr(10) || chr(10) || chr(10) || chr(10) || 'end  ' WHEN 1 THEN '[' || text || '](http://x) a' WHEN 2 THEN '```' || chr(10) || text || chr(10) || '``` ' ELSE text || ' <Tab a=1/> ' END",
}
#: One section for each document.
CHUNKS = {
    "package_id": "coalesce(source, '')", "doc_path": "'docs/' || CAST(doc_id % 300 AS STRING) || '.md'", "doc_title": "'Guide ' || lang", "section_title": "substring(text, 1, 24)", "content": "text",
    "doc_id": "doc_id", "tokens": "CAST(ceil(length(text) / 4.0) AS BIGINT)",
}
#: Topics of whole words of the benchmark's texts, each asked of five packages: words, phrases and operators.
W2, W3, W4, W5 = (f"lower(translate(translate(split_part(text, ' ', {n}), 'éèêëàâçñóíáúüäöß', 'eeeeaacnoiauuaos'), '.,;:!?' || chr(10), ''))" for n in (2, 3, 4, 5))
QUERIES = {
    "query_id": "item_id * 5 + k", "package_id": "'src' || CAST((item_id + 4 * k) % 20 AS STRING)",
    "topic": f"CASE (item_id * 5 + k) % 6 WHEN 0 THEN {W2} WHEN 1 THEN {W2} || ' ' || {W4} WHEN 2 THEN '\"' || {W2} || ' ' || {W3} || '\"' WHEN 3 THEN {W3} || ' OR ' || {W4} WHEN 4 THEN {W2} || ' NOT ' || {W4} ELSE '\"' || {W4} || ' ' || {W5} || '\" OR ' || {W2} || ' OR ' || {W5} END",
}
RELEASES = {
    "registry": "CASE o_custkey % 3 WHEN 0 THEN 'npm' ELSE 'pip' END", "name": "'pkg' || CAST(o_custkey % 40 AS STRING)", "ord": "o_orderkey",
    "version": "CAST(o_orderkey % 4 AS STRING) || '.' || CAST(o_orderkey % 12 AS STRING) || '.' || CAST(o_orderkey % 23 AS STRING) || CASE o_orderkey % 13 WHEN 0 THEN '-beta.' || CAST(o_orderkey % 12 AS STRING) WHEN 1 THEN 'rc1' ELSE '' END",
    "published_at": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
}
ENTRIES = {
    "registry": "CASE n_nationkey % 2 WHEN 0 THEN 'npm' ELSE 'pip' END", "name": "'pkg' || CAST(n_nationkey AS STRING)",
    "min0": "CAST(n_nationkey % 3 AS STRING) || '.2.0'", "max0": "CASE n_nationkey % 4 WHEN 0 THEN NULL ELSE CAST(n_nationkey % 3 + 2 AS STRING) || '.0'  END", "min1": "'0.5.0'", "listed": "'1.' || CAST(n_nationkey % 12 AS STRING) || '.3'",
    "repo": "'repo' || CAST(n_regionkey AS STRING)",
}
CATALOG = {
    "name": "'lib' || CAST(p_partkey % 97 AS STRING)", "load_ord": "p_partkey", "size_bytes": "CAST(p_size AS BIGINT) * 1000", "section_count": "p_partkey % 70", "registry": "CASE p_partkey % 2 WHEN 0 THEN 'npm' ELSE 'pip' END",
    "version": "CAST(p_partkey % 3 AS STRING) || '.' || CAST(p_partkey % 11 AS STRING) || '.0'",
}
TAGS = {
    "repo": "'repo' || CAST(s_nationkey % 5 AS STRING)", "ord": "s_suppkey", "ts": "CAST(s_suppkey * 7919 % 100000 AS BIGINT)",
    "tag": "CASE s_suppkey % 4 WHEN 0 THEN '@scope/pkg' || CAST(s_suppkey % 3 AS STRING) || '@' WHEN 1 THEN 'Pkg' || CAST(s_suppkey % 3 AS STRING) || '@' WHEN 2 THEN 'v' ELSE '' END || CAST(s_suppkey % 3 AS STRING) || '.' || CAST(s_suppkey % 12 AS STRING) || '.' || CAST(s_suppkey % 30 AS STRING) || CASE s_suppkey % 9 WHEN 0 THEN '-rc.1' ELSE '' END",
}
SITES = {"page_id": "page_id", "url": "url", "body": "CASE page_id % 11 WHEN 0 THEN '' ELSE html END", "status": "CASE page_id % 9 WHEN 0 THEN 404 ELSE 200 END", "content_type": "CASE page_id % 12 WHEN 0 THEN 'image/png' WHEN 1 THEN NULL WHEN 2 THEN 'text/plain' WHEN 3 THEN 'Application/PDF' WHEN 4 THEN 'font/woff2' WHEN 5 THEN 'application/xhtml+xml' WHEN 6 THEN '' WHEN 7 THEN 'application/zip' ELSE 'text/html; charset=utf-8' END", "content_length": "CASE page_id % 10 WHEN 0 THEN CAST(20000000 AS BIGINT) ELSE CAST(length(html) AS BIGINT) END"}
RESULTS = {
    "registry": "CASE o_orderkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pip' ELSE 'hex' END", "name": "'pkg' || CAST(o_custkey % 40 AS STRING)", "version": "CAST(o_orderkey AS STRING)", "skipped": "o_orderkey % 5 = 0",
    "error": "CASE o_orderkey % 19 WHEN 0 THEN 'fatal: Remote branch v1 not found in upstream origin' WHEN 1 THEN 'Connection reset by peer' WHEN 2 THEN 'no sections' WHEN 3 THEN 'The requested URL returned error: 503' WHEN 4 THEN 'Failed to connect to host port 443' WHEN 5 THEN 'error: RPC failed; curl 56'"
    " WHEN 6 THEN 'GnuTLS recv error (-110)' WHEN 7 THEN 'could not find remote ref v2' WHEN 8 THEN 'error: pathspec v4 did not match any file' WHEN 9 THEN 'reference v5 did not match' WHEN 10 THEN 'remote: Repository not found.' WHEN 11 THEN 'returned error: 404' END",
    "sections": "o_orderkey % 60", "tokens": "o_orderkey % 9000",
}


def zipped(rows: pd.DataFrame) -> pd.DataFrame:
    """The files (path, content) of one nation as an archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docs/", "")
        for path, content in sorted(zip(rows["path"], rows["content"], strict=True)):
            z.writestr(path, content)
    return pd.DataFrame({"nation": [rows["nation"].iloc[0]], "content": [out.getvalue()]})


def store_zipped(folder: str, rows: DataFrame) -> None:
    """Write an archive for each nation into a shared folder; one in five is broken."""

    def write(own: pd.DataFrame) -> pd.DataFrame:
        (nation,) = own["nation"].unique()
        content = b"PK no archive" if nation % 5 == 4 else zipped(own)["content"].iloc[0]
        place = folder.removeprefix("file:")
        os.makedirs(place, exist_ok=True)
        # The name is taken by one step, so that a second try of a task replaces the first one's file.
        draft = f"{place}/.{nation}-{uuid.uuid4()}"
        with open(draft, "wb") as f:
            f.write(content)
        os.replace(draft, f"{place}/{nation}.zip")
        return pd.DataFrame({"nation": [nation]})

    rows.groupBy("nation").applyInPandas(write, "nation long").count()


def dealt(rows: DataFrame, each: int) -> DataFrame:
    """Narrow rows dealt to tasks of about so many, for work that is made from them: files are read by their bytes, and a
    few MB of keys would be one task."""
    return rows.repartition(-(-rows.count() // each) or 1)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("*", "explode(array(0, 1, 2, 3, 4)) AS k")
    return asked.selectExpr(*(f"{e} AS {c}" for c, e in QUERIES.items()))


def frame(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def sql(name: str, table: str, columns: dict[str, str]) -> str:
    """The same as a named subquery."""
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table})"
