"""Selection of documentation files by path and content; every rule is a column expression on (package_id, path)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.text import file_name

# Extensions, locale codes, directories and names that hold no documentation.
EXTENSIONS = "md|mdx|mdoc|qmd|rmd|adoc|rst|html|htm"
ARCHIVE_EXTENSIONS = "md|mdx|qmd|rmd|adoc|rst|html|htm"
LOCALES = "ar bg bn ca cs da de el en es et fa fi fr he hi hr hu id it ja ko lt lv ms nl no pl pt ro ru sk sl sr sv th tr uk vi zh zh-cn zh-tw zh-hans zh-hant pt-br es-la".split()
IGNORED_NAMES = "code_of_conduct contributing changelog history license security pull_request_template issue_template claude".split()
IGNORED_DIRS = "__tests__ __test__ test tests spec specs fixtures __fixtures__ __mocks__ internal dev plans .plans node_modules dist build out .next .nuxt examples benchmarks benchmark".split()
GENERATED_NAMES = "allpackages-index.html allclasses-index.html index-all.html constant-values.html serialized-form.html deprecated-list.html help-doc.html overview-tree.html genindex.html search.html searchindex.js py-modindex.html".split()
DOCS_FOLDERS = "docs documentation doc".split()


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def is_documentation(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(f"\\.({EXTENSIONS})$")


def in_ignored_directory(path: Column) -> Column:
    return F.exists(directories(path), lambda d: F.lower(d).isin(IGNORED_DIRS))


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda d: d.startswith("."))


def is_boilerplate(path: Column) -> Column:
    return F.regexp_replace(F.lower(file_name(path)), f"\\.({EXTENSIONS})$", "").isin(IGNORED_NAMES)


def is_fixture(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(f"\\.(expect|test|spec)\\.({EXTENSIONS})$")


def in_wanted_locale(path: Column, lang: Column) -> Column:
    """Every locale directory must be wanted: any for ``all``, the given one, or English where none is given."""
    wanted = lambda d: (F.coalesce(lang, F.lit("")) == "all") | (F.lower(d) == F.lower(F.coalesce(F.nullif(lang, F.lit("")), F.lit("en"))))
    return F.forall(directories(path), lambda d: ~F.lower(d).isin(LOCALES) | wanted(d))


def select_files(files: DataFrame, lang: Column | None = None) -> DataFrame:
    """Files that all path rules accept."""
    p = F.col("path")
    return files.filter(is_documentation(p) & ~in_ignored_directory(p) & ~is_hidden(p) & ~is_boilerplate(p) & ~is_fixture(p) & in_wanted_locale(p, lang if lang is not None else F.lit(None).cast("string")))


def ignore_regex(pattern: str) -> str:
    """A regular expression, in any case, for one ignore pattern, matched against a path (directories end in a slash)."""
    body = re.sub(r"(?<!\\)\s+$", "", pattern)
    only_dir = body.endswith("/")
    body = body.rstrip("/")
    rooted = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        whole = i == 0 or body[i - 1] == "/"
        listed = re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(body, i)
        if whole and body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif whole and body[i:] == "**":
            out, i = out + ".+", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + len(re.match(r"\*+", body[i:])[0])
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif listed:
            inner = re.sub(r"([\[\]&^\\])", r"\\\1", listed[2])
            out, i = out + ("[^/" if listed[1] else "[") + inner + "]", listed.end()
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return "(?i)" + ("^" if rooted else "^(?:.*/)?") + out + ("/$" if only_dir else "/?$")


@F.pandas_udf(StringType())
def _compiled(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: ignore_regex(p.removeprefix("!")).removeprefix("(?i)"))


def matchers(rules: DataFrame) -> DataFrame:
    """(package_id, ignores): one expression for all rules (package_id, ord, pattern) of a package; it fits what they ignore.

    The last rule that fits decides: later rules stand first, one that keeps is a look-ahead before all earlier ones.
    """
    own = rules.filter(~F.col("pattern").rlike("^(#|\\s*$)")).select("package_id", F.struct("ord", _compiled("pattern").alias("rx"), F.col("pattern").startswith("!").alias("keep")).alias("r"))
    listed = own.groupBy("package_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    behind = lambda a: F.when(a.keep, a.rx).otherwise(F.concat(F.lit("(?:"), a.rx, F.lit(")")))
    added = lambda a, r: F.struct(F.when(r.keep, F.concat(F.lit("(?!"), r.rx, F.lit(")"), behind(a))).otherwise(F.concat(r.rx, F.lit("|"), a.rx)).alias("rx"), r.keep.alias("keep"))
    nothing = F.struct(F.lit("(?!)").alias("rx"), F.lit(False).alias("keep"))
    return listed.select("package_id", F.concat(F.lit("(?i)"), F.aggregate("r", nothing, added).rx).alias("ignores"))


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no repository rule (package_id, ord, pattern) ignores: the last matching rule decides, and an ignored
    directory hides what lies below it.

    A package's rules are one expression. Each distinct directory is judged once, and its verdict goes to all directories
    below; a file is judged by its own path alone. Without a package or rules a file stays; without a path it is ignored by any rule.
    """
    rx = matchers(rules)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    folders = files.select("package_id", folder.alias("_folder")).filter("_folder <> ''").distinct().join(rx.select("package_id"), "package_id", "left_semi")
    parts = F.split("_folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    each = folders.select("package_id", "_folder", F.explode(above).alias("_above"))
    judged = each.select("package_id", "_above").distinct().join(rx, "package_id").filter(F.regexp_like("_above", F.col("ignores"))).select("package_id", "_above")
    hidden = each.join(judged, ["package_id", "_above"], "left_semi").select("package_id", "_folder").distinct()
    rest = files.withColumn("_folder", folder).join(hidden, ["package_id", "_folder"], "left_anti")
    rest = rest.join(rx.withColumnRenamed("ignores", "_ignores"), "package_id", "left")
    return rest.filter(F.col("_ignores").isNull() | ~F.regexp_like("path", F.col("_ignores"))).select(files.columns)


def glob_regex(glob: str) -> str:
    """Anchored expression: ``*`` inside a segment, ``**`` across; a question mark is not special."""
    out = re.sub(r"[.+^${}()|\[\]\\]", lambda m: "\\" + m[0], glob)
    return "^" + re.sub(r"\*\*|\*", lambda m: ".*" if m[0] == "**" else "[^/]*", out) + "$"


def archive_entries(entries: DataFrame, docs_path: str = "", exclude: list[str] | None = None) -> DataFrame:
    """Entries (path) of archives that hold documentation, with paths relative to the docs folder."""
    prefix = docs_path.strip("/") + "/" if docs_path.strip("/") else ""
    rel = F.substring(F.col("path"), len(prefix) + 1, 1 << 20)
    out = entries.filter(~F.col("path").endswith("/") & F.col("path").startswith(prefix)).withColumn("rel_path", rel)
    name = file_name(F.col("rel_path"))
    out = out.filter(F.lower(name).rlike(f"\\.({ARCHIVE_EXTENSIONS})$") & ~name.isin(GENERATED_NAMES))
    for g in exclude or []:
        out = out.filter(~F.col("rel_path").rlike(glob_regex(g)))
    return out


def docs_folders(files: DataFrame) -> DataFrame:
    """(package_id, docs_folder): the first known folder among the top directories, as it is spelt."""
    top = F.element_at(F.split("path", "/"), 1)
    rank = F.array_position(F.array(*map(F.lit, DOCS_FOLDERS)), F.lower(top))
    return files.filter(F.instr("path", "/") > 0).select("package_id", F.when(rank > 0, F.struct(rank.alias("rank"), top.alias("name"))).alias("t")).groupBy("package_id").agg(F.min("t").getField("name").alias("docs_folder"))


def content_key(content: Column) -> Column:
    return F.substring(F.md5(content.cast("binary")), 1, 16)


def first_copies(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by ``order``; the key's minimum is found with partial sums, so that a hot key
    is no hot task, and rows join it back."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first")).select(*(F.col(k).alias(f"_{k}") for k in key), "_first")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(first, same & (F.struct(*order) == F.col("_first")), "left_semi")


def unique_files(files: DataFrame) -> DataFrame:
    """Files without later exact copies in their package; a file with null content has no copies."""
    key = F.coalesce(content_key(F.col("content")), F.concat(F.lit("file "), F.col("file_ord").cast("string")))
    return first_copies(files.withColumn("content_key", key), ["package_id", "content_key"], ["file_ord"]).drop("content_key")
