"""Spelling variants, by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys. Words that share a key are joined by it and verified
to be exactly one inserted, deleted or replaced code point apart. Two such words share exactly one key: the shorter word
itself, or both words without the replaced code point. So each pair comes once, and counts need no removal of repeats. A
key of k code points is shared by at most (k + 1) times the alphabet's size words, which bounds what meets at a key
whatever the number of rows.

A word's form is its near word of the largest count (ties: the least in code-point order), if it is at least ``TIMES`` as
frequent as the word. Roots follow the forms to the last by pointer jumping: each join doubles the steps, and only words
whose last known form has a form itself take part. Counts rise along a chain by a factor, so chains are short.

Text is cut into maximal runs of letters; only A-Z are lower-cased. A fixed share of (document, run) pairs loses one code
point, by a checksum. Null texts have no words, a null id counts as the empty text in the checksum; repeated rows count
again, an empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.tables import table, written

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, TIMES, ODD = 6, 5, 5, 199


def without(word: Column, at: Column) -> Column:
    """The word without its code point at a place counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, odd: int = ODD) -> DataFrame:
    """(word, n) of the words of all documents (doc_id, text) that are long and frequent enough."""
    runs = F.filter(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0)), lambda w: F.char_length(w) >= min_length)
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    short = without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))
    each = each.select(F.when(F.col("h") % odd == 0, short).otherwise(F.col("run")).alias("word"))
    counted = each.groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def keyed(counted: DataFrame) -> DataFrame:
    """(key, word, n): each word under itself and its distinct single deletions."""
    word = F.col("word")
    cuts = F.transform(F.sequence(F.lit(0), F.char_length(word) - 1), lambda k: without(word, k))
    return counted.select(F.explode(F.array_distinct(F.concat(F.array(word), cuts))).alias("key"), "word", "n")


def near_pairs(counted: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all pairs of words that are one edit apart, in both directions."""
    keys = keyed(counted)
    other = keys.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return keys.join(other, "key").filter((F.col("word") != F.col("near")) & (F.levenshtein("word", "near") == 1)).drop("key")


def forms(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): every word, with what is known of its near words."""
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    near = near_pairs(counted).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = counted.join(near, "word", "left")
    most = -F.col("best.m")
    enough = most >= times * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, most).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; ``found`` is stored, as it is read several times."""
    links = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        # the root of a root, if it has one: after k rounds a link spans 2^k forms
        joined = written(links.join(step, F.col("root") == F.col("at"), "left").select("word", "root", "next"), "roots")
        if joined.filter("next is not null").isEmpty():
            return joined.select("word", "root")
        links = joined.select("word", F.coalesce("next", "root").alias("root"))


def grouped(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    found = written(forms(written(words(docs), "words")), "forms")
    last = roots(found).select(F.col("word").alias("of"), F.col("root").alias("last"))
    out = found.join(last, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    return grouped(table(spark, sf_dir, "documents", "doc_id", "text"))


#: The checksum is worked out byte by byte from its polynomial; pairs of words by a distance in bytes and then
#: in code points, without keys.
OP11_SQL = f"""WITH RECURSIVE steps AS MATERIALIZED (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) c FROM (SELECT unnest(range(256)) i))),
runs AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run h, run, count(*) n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) run FROM documents) WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
bytes AS (SELECT run, n, list_transform(range(strlen(h)), lambda i: CAST('0x' || substr(hex(encode(h)), 2 * i + 1, 2) AS BIGINT)) b FROM runs),
sums AS MATERIALIZED (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + xor(c & 255, x)]), 4294967295), 4294967295) h FROM bytes, steps),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) n FROM (SELECT CASE WHEN h % {ODD} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, n FROM sums) WHERE length(word) >= {MIN_LENGTH} GROUP BY 1 HAVING sum(n) >= {MIN_COUNT}),
close AS MATERIALIZED (SELECT a.word, a.n, b.word other, b.n m FROM words a JOIN words b ON abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word AND levenshtein(a.word, b.word) <= 2),
near AS (SELECT word, n, count(*) n_near, max(m) most, arg_min(other, (-m, other)) form FROM close WHERE CASE WHEN length(word) = length(other)
  THEN len(list_filter(range(length(word)), lambda i: substr(word, i + 1, 1) <> substr(other, i + 1, 1))) = 1
  ELSE len(list_filter(range(greatest(length(word), length(other))), lambda i: CASE WHEN length(word) > length(other) THEN substr(word, 1, i) || substr(word, i + 2) = other ELSE substr(other, 1, i) || substr(other, i + 2) = word END)) > 0 END GROUP BY ALL),
forms AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) n_near, CASE WHEN most >= {TIMES} * w.n THEN form END form, CASE WHEN most >= {TIMES} * w.n THEN most END form_n FROM words w LEFT JOIN near USING (word)),
walk AS (SELECT word, word step FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON w.step = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.step root FROM walk w JOIN forms f ON w.step = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
