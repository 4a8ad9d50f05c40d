"""URL filters: a temporal join of captures with dated lists.

A list's entries are changes: from a date on, a key (a whole URL, a host or a domain) is added or removed. A
window per key turns them into validity intervals; a capture is judged by the entries that were active at its
fetch time (from <= fetched < to). Only built-in functions run.

A capture row stays one row: the intervals of a key are one row of a history table, which holds at most one change
for each list and date, and captures join it by key. A key with more than ``CAPTURES_A_TASK`` captures is dealt out
by a salt, and only such a key's history is repeated; so one host with a third of all captures fills many tasks.

Null or unparsable URLs have no keys and match nothing; a null fetch time matches nothing; changes of one key on one
date count as the last action by name (remove after add, so the entry ends); entries with nulls in list, scope, key,
date or action are left out. Repeated captures stay. Empty tables give empty or unmatched results; further columns of
captures are kept, whatever their names (a column that has a result's name is replaced by it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.tables import boxed, checkpointed, table

CAPTURES_A_TASK = 250_000
SCOPES = ("url", "host", "domain")
# Fixed value: second levels under which names are registered in many countries.
SECOND = "(?:co|com|org|net|gov|ac|edu)"


def canonical(url: Column) -> Column:
    """Scheme and fragment gone, host in lower case without www, tracking parameters and a last slash dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host, path = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.", ""), F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "([?&])utm_[^&]*", "$1"), "\\?&+", "?"), "[?&/]+$", "")
    return F.concat(host, path)


def keys(url: Column) -> dict[str, Column]:
    """The key of each scope; null where the URL has no host."""
    whole = canonical(url)
    host = F.regexp_replace(F.regexp_extract(whole, "^[^/?]*", 0), ":[0-9]+$", "")
    domain = F.coalesce(F.nullif(F.regexp_extract(host, f"[^.]+\\.(?:{SECOND}\\.[a-z][a-z]|[^.]+)$", 0), F.lit("")), host)
    named = F.length(host) > 0
    return {"url": F.when(named, whole), "host": F.when(named, host), "domain": F.when(named, domain)}


def intervals(changes: DataFrame) -> DataFrame:
    """(list_name, scope, key, valid_from, valid_to) of changes (list_name, scope, key, changed_at, action)."""
    changes = changes.select("list_name", "scope", "key", "changed_at", "action").na.drop().filter(F.col("action").isin("add", "remove"))
    daily = changes.groupBy("list_name", "scope", "key", "changed_at").agg(F.max("action").alias("action"))
    following = W.partitionBy("list_name", "scope", "key").orderBy("changed_at")
    return daily.withColumn("valid_to", F.lead("changed_at").over(following)).filter("action = 'add'").select("list_name", "scope", "key", F.col("changed_at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched_at", captures_a_task: int = CAPTURES_A_TASK) -> DataFrame:
    """The captures with matched_lists (distinct names, ascending), n_matches and blocked."""
    rows = captures.select(boxed(captures), F.col(fetched).alias("at"), *(k.alias(f"{s}_key") for s, k in keys(F.col(url)).items()))
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), F.col(f"{s}_key").alias("key")) for s in SCOPES))).alias("e")).select("e.*")
    spans = intervals(changes).groupBy("scope", "key").agg(F.sort_array(F.collect_list(F.struct("list_name", "valid_from", "valid_to"))).alias("spans"))
    hot = each.filter("key is not null").groupBy("scope", "key").agg(F.ceil(F.count("*") / captures_a_task).cast("int").alias("salts")).filter("salts > 1")
    hot = checkpointed(hot.join(spans.select("scope", "key"), ["scope", "key"], "left_semi"))  # at most one row for each captures_a_task captures and scope
    history = spans.join(F.broadcast(hot), ["scope", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    found = []
    for s in SCOPES:
        salts = hot.filter(F.col("scope") == s).select(F.col("key").alias(f"{s}_key"), "salts")
        rows = rows.join(F.broadcast(salts), f"{s}_key", "left").withColumn(f"{s}_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        side = history.filter(F.col("scope") == s).select(F.col("key").alias(f"{s}_key"), F.col("salt").alias(f"{s}_salt"), F.col("spans").alias(f"{s}_spans"))
        rows = rows.join(side, [f"{s}_key", f"{s}_salt"], "left")
        found.append(F.coalesce(F.filter(f"{s}_spans", lambda x: (x.valid_from <= F.col("at")) & (x.valid_to.isNull() | (F.col("at") < x.valid_to))), F.array()))
    judged = rows.select("row", F.concat(*found).alias("active"))
    kept = [F.col("row").getField(c).alias(c) for c in captures.columns if c not in ("matched_lists", "n_matches", "blocked")]
    return judged.select(*kept, F.array_sort(F.array_distinct(F.transform("active", lambda x: x.list_name))).alias("matched_lists"), F.size("active").alias("n_matches"), (F.size("active") > 0).alias("blocked"))


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the fetch time, in days, follows from the id."""
    return pages.select("page_id", "url", F.pmod(F.pmod("page_id", F.lit(366)) * 37, F.lit(366)).cast("int").alias("fetched_at"))


def derived_changes(pages: DataFrame) -> DataFrame:
    """Dated lists over the hosts, domains and URLs that occur: dates and membership follow from a hash of the key."""
    all_keys = keys(F.col("url"))
    named = pages.select(F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), k.alias("key")) for s, k in all_keys.items()))).alias("e")).select("e.*").filter("key is not null").distinct()
    digit = lambda at, n: F.conv(F.substring(F.md5("key"), at, n), 16, 10).cast("int")
    listed = named.filter(digit(1, 2) < F.when(F.col("scope") == "domain", 64).when(F.col("scope") == "host", 80).otherwise(26))
    start, lasts, again = digit(3, 3) % 300, 20 + digit(6, 2) % 90, digit(8, 1)
    dated = F.array(
        F.struct(start.alias("changed_at"), F.lit("add").alias("action")),
        F.struct((start + lasts).alias("changed_at"), F.lit("remove").alias("action")),
        F.struct(F.when(again < 8, start + lasts + 30).alias("changed_at"), F.lit("add").alias("action")),
    )
    list_name = F.concat(F.col("scope"), F.lit("_list_"), (digit(9, 1) % 2).cast("string"))
    return listed.select(list_name.alias("list_name"), "scope", "key", F.explode(dated).alias("e")).select("list_name", "scope", "key", "e.*").filter("changed_at is not null")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the entries active when it was fetched."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    out = evaluate(derived_captures(pages), derived_changes(pages))
    return out.withColumn("matched_lists", F.array_join("matched_lists", ","))


OP2_SQL = r"""
WITH c0 AS (SELECT page_id, url, CAST(((page_id % 366) * 37) % 366 AS INTEGER) AS fetched_at,
    regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM pages),
c1 AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', '') AS h,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '([?&])utm_[^&]*', '\1', 'g'), '\?&+', '?', 'g'), '[?&/]+$', '') AS p FROM c0),
c2 AS (SELECT page_id, url, fetched_at, h || p AS url_key, regexp_replace(h, ':[0-9]+$', '') AS host FROM c1),
c AS (SELECT *, coalesce(nullif(regexp_extract(host, '[^.]+\.(?:(?:co|com|org|net|gov|ac|edu)\.[a-z][a-z]|[^.]+)$'), ''), host) AS domain FROM c2 WHERE length(host) > 0),
k AS (SELECT page_id, fetched_at, 'url' AS scope, url_key AS key FROM c UNION ALL SELECT page_id, fetched_at, 'host', host FROM c UNION ALL SELECT page_id, fetched_at, 'domain', domain FROM c),
n AS (SELECT DISTINCT scope, key, md5(key) AS m FROM k),
l AS (SELECT scope, key, scope || '_list_' || (CAST('0x' || substr(m, 9, 1) AS INTEGER) % 2) AS list_name, CAST('0x' || substr(m, 3, 3) AS INTEGER) % 300 AS s,
    20 + CAST('0x' || substr(m, 6, 2) AS INTEGER) % 90 AS d, CAST('0x' || substr(m, 8, 1) AS INTEGER) AS g FROM n
    WHERE CAST('0x' || substr(m, 1, 2) AS INTEGER) < CASE scope WHEN 'domain' THEN 64 WHEN 'host' THEN 80 ELSE 26 END),
e AS (SELECT list_name, scope, key, s AS changed_at, 'add' AS action FROM l UNION ALL SELECT list_name, scope, key, s + d, 'remove' FROM l UNION ALL SELECT list_name, scope, key, s + d + 30, 'add' FROM l WHERE g < 8),
i AS (SELECT *, lead(changed_at) OVER (PARTITION BY list_name, scope, key ORDER BY changed_at) AS valid_to FROM e),
m AS (SELECT k.page_id, i.list_name FROM k JOIN i ON k.scope = i.scope AND k.key = i.key AND i.action = 'add' AND i.changed_at <= k.fetched_at AND (i.valid_to IS NULL OR k.fetched_at < i.valid_to)),
a AS (SELECT page_id, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS names, count(*) AS n FROM m GROUP BY page_id)
SELECT c0.page_id, c0.url, c0.fetched_at, coalesce(a.names, '') AS matched_lists, CAST(coalesce(a.n, 0) AS INTEGER) AS n_matches, coalesce(a.n, 0) > 0 AS blocked FROM c0 LEFT JOIN a USING (page_id)
"""
