"""Link extraction and crawl tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import urls
from docloom.functions.text import trimmed

LINKS_KEPT = 500
LARGEST_PAGE = 10 * 1024 * 1024


def index_links(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, section, title, url) of list-item links, with the second-level heading above."""
    lines = docs.select("doc_id", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    head = F.when(F.col("line").rlike("^##\\s+\\S"), F.trim(F.regexp_extract("line", "^##\\s+(.+)$", 1)))
    # Fixed value: a list item that starts with a link, whose title in quotes is left out.
    rule = "^\\s*[-*]\\s*\\[([^\\]]+)\\]\\(([^)\\s]+)(?:\\s+\"[^\"]*\")?\\)"
    upto = W.partitionBy("doc_id").orderBy("line_no")
    out = lines.withColumn("section", F.last(head, ignorenulls=True).over(upto))
    return out.filter(F.col("line").rlike(rule)).select("doc_id", "line_no", "section", F.trim(F.regexp_extract("line", rule, 1)).alias("title"), F.regexp_extract("line", rule, 2).alias("url"))


def resolved(links: DataFrame) -> DataFrame:
    """Links (base_url, url) with addresses resolved against their index's; those that the standard refuses are dropped."""
    return links.withColumn("url", urls.joined("base_url", "url")).filter("url is not null")


def same_host_links(links: DataFrame, limit: int = LINKS_KEPT) -> DataFrame:
    """Resolved links on their index's host and port: the first of each URL, at most ``limit`` an index in order."""
    own = links.filter(urls.origin_host("base_url") == urls.origin_host("url"))
    first = own.groupBy("doc_id", "url").agg(F.min(F.struct("line_no", "title")).alias("f")).select("doc_id", "url", "f.line_no", "f.title")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no", "url"))).filter(F.col("rank") <= limit)


def followed(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Resolved links with the fetched page of their URL; ok is false for missing and empty ones.

    Pages meet links by the final form of their URL, on a hash and then the text.
    """
    p = pages.withColumn("url", known_url("url")).groupBy("url").agg(F.max(F.coalesce("body", F.lit(""))).alias("body")).select(F.xxhash64("url").alias("_h"), F.col("url").alias("_url"), "body")
    out = links.join(p, (F.xxhash64("url") == F.col("_h")) & (F.col("url") == F.col("_url")), "left").drop("_h", "_url")
    return out.withColumn("ok", F.coalesce(F.trim("body") != "", F.lit(False)))


def follow_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count_if("ok").alias("n_fetched"), F.count_if(~F.col("ok")).alias("n_failed"))


def is_html(content_type: Column, body: Column) -> Column:
    """By content type; by an html tag among the first 1,024 characters only where no type is given."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(kind == "", F.coalesce(F.substring(body, 1, 1024).rlike("(?i)<html[\\s>]"), F.lit(False))).otherwise(kind.contains("text/html") | kind.contains("application/xhtml"))


def triage(pages: DataFrame, article: Column | None = None) -> DataFrame:
    """Pages (url, status, content_type, content_length, body) with kind (html, text) or the reason they are refused.

    ``article``, where given, is the main article of an html page; a page with none is refused.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    html = is_html(F.col("content_type"), F.col("body"))
    reason = (
        F.when((F.col("status") < 200) | (F.col("status") > 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(F.coalesce("content_length", F.lit(0)) > LARGEST_PAGE, "too large")
        .when(kind.rlike("^(image|video|audio)/") | kind.contains("application/pdf"), "binary")
        .when(F.coalesce(F.octet_length("body"), F.lit(0)) > LARGEST_PAGE, "too large")
        .when(F.coalesce(trimmed(F.col("body")), F.lit("")) == "", "empty")
    )
    if article is not None:
        reason = reason.when(html & (F.coalesce(trimmed(article), F.lit("")) == ""), "no readable article")
    return pages.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).withColumn("kind", F.when(F.col("reason").isNull(), F.when(html, "html").otherwise("text")))


def known_url(url: str) -> Column:
    """A fetched page's URL in its final form; as it stands where it is none."""
    return F.coalesce(urls.final_form(url), F.col(url))


def path_of(url: str, default_extension: str) -> Column:
    """Host with its port, and path without the last slash, index for the root, with an extension where none is known."""
    bare = lambda u: urls.swapped(urls.swapped(f"{u}.path", "/$"), "^$", "/index")
    known = lambda u: urls.matches(f"{u}.path", r"(?i)\.(md|mdx|html?|adoc|rst|txt)/?$")
    return urls.part(url, lambda u: f"concat({u}.host, {u}.port, {bare(u)}, CASE WHEN {known(u)} THEN '' ELSE '{default_extension}' END)")


def _bare_host(u: str) -> str:
    return urls.swapped(f"{u}.host", r"^www\.")


def package_name(url: str) -> Column:
    return urls.part(url, _bare_host)


def suggested_name(url: str) -> Column:
    """Host, and the path as a slug after a dash."""

    def named(u: str) -> str:
        slug = urls.swapped(urls.swapped(f"lower({u}.path)", "[^a-z0-9]+", "-"), "^-|-$")
        return f"concat_ws('-', {_bare_host(u)}, nullif({slug}, ''))"

    return urls.part(url, named)


def index_candidates(sites: DataFrame) -> DataFrame:
    """(url, candidate, ord): a given index file itself, else the full index, then the short one, below its host and path."""

    def options(u: str) -> str:
        base = f"concat({u}.scheme, '://', {u}.host, {u}.port, {urls.swapped(f'{u}.path', '/$')})"
        below = urls.let(base, lambda b: f"array(concat({b}, '/llms-full.txt'), concat({b}, '/llms.txt'))")
        return urls.case((urls.matches(f"{u}.path", r"/llms(-full)?\.txt$"), "array(url)"), other=below)

    return sites.select("url", F.posexplode(urls.part("url", options)).alias("ord", "candidate"))


def chosen_index(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, index_url): the first candidate that has content; pages are known by the final form of their URL."""
    have = pages.filter(F.trim("body") != "").select(known_url("url").alias("known")).distinct()
    asked = index_candidates(sites).withColumn("known", known_url("candidate"))
    return asked.join(have, "known").groupBy("url").agg(F.min_by("candidate", "ord").alias("index_url"))


def site_corpus(sites: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """(url, doc_url, role): the index document and what its links give (a full index is not followed), else the page."""
    index = chosen_index(sites, pages)
    top = index.select("url", F.col("index_url").alias("doc_url"), F.lit("index").alias("role"))
    have = pages.filter(F.trim("body") != "").select(known_url("url").alias("known")).distinct()
    given = links.select(known_url("base_url").alias("from_url"), F.col("url").alias("doc_url"), known_url("url").alias("known")).distinct()
    below = index.filter(~F.col("index_url").endswith("llms-full.txt")).withColumn("from_url", known_url("index_url")).join(given, "from_url")
    below = below.join(have, "known", "left_semi").select("url", "doc_url", F.lit("linked").alias("role"))
    single = sites.select("url").distinct().join(index, "url", "left_anti").select("url", F.col("url").alias("doc_url"), F.lit("page").alias("role"))
    return top.unionByName(below).unionByName(single)


def source_kind(source: Column) -> Column:
    """git, url (a package to download), website or file."""
    web = source.rlike("^https?://")
    ssh = source.startswith("git://") | source.startswith("ssh://") | source.rlike("^git@[A-Za-z0-9_.-]+:[A-Za-z0-9_./-]+$")
    # Fixed value: hosts of repositories; only their root and tree paths count.
    hosted = source.rlike("^https?://(github|gitlab|bitbucket|codeberg)\\.[^/]+/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(/tree/.*)?$")
    git = source.rlike("(?i)^https?://.*\\.git$") | ssh | hosted
    return F.when(git, "git").when(web & source.endswith(".db"), "url").when(web, "website").otherwise("file")


def tree_url(url: Column) -> Column:
    """(repo, ref) of a URL with a tree part; all that follows is the ref."""
    rule = "^(https?://[^/]+/[^/]+/[^/]+)/tree/(.+)$"
    return F.struct(F.when(url.rlike(rule), F.regexp_extract(url, rule, 1)).otherwise(url).alias("repo"), F.when(url.rlike(rule), F.regexp_extract(url, rule, 2)).alias("ref"))


def repo_name(url: Column) -> Column:
    """The owner of a pages repository, a domain without its end and js, else the last path part; without .js and -docs."""
    bare = F.regexp_replace(url, "\\.git$", "")
    bare = F.when(bare.contains("@") & bare.contains(":"), F.substring_index(bare, ":", -1)).otherwise(bare)
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    last, owner = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("unknown")), F.try_element_at(parts, F.lit(-2))
    domain = "(?i)\\.(com|org|io|dev|net|site|app)$"
    pages = last.endswith(".github.io") & owner.isNotNull()
    name = F.when(pages, owner).when(last.rlike(domain), F.regexp_replace(F.regexp_replace(last, domain, ""), "(?i)js$", "")).otherwise(last)
    name = F.regexp_replace(F.regexp_replace(F.lower(name), "\\.js$", ""), "-docs?$", "")
    name = F.regexp_replace(F.regexp_replace(name, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(name == "", "unknown").otherwise(name)
