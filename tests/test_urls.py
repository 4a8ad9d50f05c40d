import pytest
from pyspark.sql import functions as F

from docloom.functions import urls

#: Address, base, and its final form by the standard (as a browser's engine gives it).
FACTS = [
    ("https://H.ORG/f/../g", None, "https://h.org/g"),
    ("https://h.org:443/a", "https://h.org/llms.txt", "https://h.org/a"),
    ("https://u@h.org/b", "https://h.org/llms.txt", "https://u@h.org/b"),
    ("https://h.org:0080/", None, "https://h.org:80/"),
    ("https://h.org:65536/", None, None),
    ("https://h.org:/x", None, "https://h.org/x"),
    ("https://:@h.org", None, "https://h.org/"),
    ("https://u:p@w@h.org/", None, "https://u:p%40w@h.org/"),
    ("../c", "https://h.org/a/b/d?q#f", "https://h.org/a/c"),
    ("", "https://h.org/a?q#f", "https://h.org/a?q"),
    ("?x='", "https://h.org/a?q#f", "https://h.org/a?x=%27"),
    ("#n o", "https://h.org/a?q#f", "https://h.org/a?q#n%20o"),
    ("//k.org", "https://h.org/a", "https://k.org/"),
    ("/\\k.org\\x", "https://h.org/a", "https://k.org/x"),
    ("https:d", "https://h.org/a/b", "https://h.org/a/d"),
    ("http:d", "https://h.org/a/b", "http://d/"),
    ("/a/%2e%2E/b/.", "https://h.org", "https://h.org/b/"),
    (" \thttps://h.org/a b\n", None, "https://h.org/a%20b"),
    ("https://h.org/é?é#é", None, "https://h.org/%C3%A9?%C3%A9#%C3%A9"),
    ("https://bücher.example/", None, "https://xn--bcher-kva.example/"),
    ("http://0x7f.1/", None, "http://127.0.0.1/"),
    ("http://1.2.3.256/", None, None),
    ("http://1.2.3.4.5/", None, None),
    ("http://099/", None, None),
    ("http://[::1]:80/", None, "http://[::1]/"),
    ("http://[::1/", None, None),
    ("http://a b/", None, None),
    ("http://h%41.org/", None, "http://ha.org/"),
    ("http://%zz/", None, None),
    ("mailto:A b@c.d", None, "mailto:A b@c.d"),
    ("javascript:alert(1)", "https://h.org", "javascript:alert(1)"),
    ("a", "mailto:x", None),
    ("a", "nonsense", None),
    ("/x", None, None),
    ("ftp://h.org:21/x", None, "ftp://h.org/x"),
    ("http://h.org", None, "http://h.org/"),
    ("//", "https://h.org", None),
    ("http://h..org./", None, "http://h..org./"),
    ("https://h.org/a//b/../../c", None, "https://h.org/a/c"),
]


def test_facts(spark):
    df = spark.createDataFrame([(i, u, b) for i, (u, b, _) in enumerate(FACTS)], "i int, u string, b string")
    got = {r.i: r.out for r in df.select("i", F.when(F.col("b").isNull(), urls.final_form("u")).otherwise(urls.joined("b", "u")).alias("out")).collect()}
    assert [(u, b, got[i]) for i, (u, b, _) in enumerate(FACTS)] == FACTS


def test_final_forms_stay(spark):
    """What the parser gives is read the same way again, and by the short way for common addresses."""
    forms = sorted({r for _, _, r in FACTS if r})
    df = spark.createDataFrame([(x,) for x in forms], "u string")
    assert {r.u: r.out for r in df.select("u", urls.final_form("u").alias("out")).collect()} == {x: x for x in forms}
    common = ["https://h.org/a/b.html?x=1&y=%20#top", "http://www.h-1.org:8080/", "https://x.org/~u/a..b/.hidden"]
    rare = ["https://h.org:443/", "https://1.2.3.4/", "https://h.org/a/../b", "https://h.org", "https://H.org/", "https://h.org/\n", "https://h.org/a b"]
    df = spark.createDataFrame([(x,) for x in common + rare], "u string")
    assert {r.u for r in df.filter(F.col("u").rlike(urls.FINAL)).collect()} == set(common)


@pytest.mark.parametrize(("url", "host", "path"), [("https://U@H.org:8443/a/./b", "h.org:8443", "/a/b"), ("http://h.org:80", "h.org", "/"), ("mailto:a@b.c", "", "a@b.c"), ("nothing", None, None), (None, None, None)])
def test_parts(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "u string")
    assert tuple(df.select(urls.origin_host("u"), urls.part("u", lambda u: f"{u}.path")).first()) == (host, path)
