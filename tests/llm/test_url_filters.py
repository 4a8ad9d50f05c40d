from pyspark.sql import functions as F

from docloom.llm import url_filters as U


def test_as_of(spark):
    changes = [("l", "host", "a.example", 5, "add"), ("l", "host", "a.example", 9, "remove"), ("m", "domain", "b.org", 0, "add"), ("m", "url", "a.example/x?p=1", 7, "add"), ("l", "host", None, 1, "add"), ("l", "host", "c.example", 3, "add"), ("l", "host", "c.example", 3, "remove"), ("l", "host", "a.example", 20, "add")]
    captures = [(1, "https://WWW.a.example/x?utm_source=f&p=1#t", 8, "k"), (2, "http://a.example/x/", 4, "k"), (3, "http://a.example", 9, "k"), (4, "http://a.example", 30, "k"), (5, "http://q.b.org:80/", 1, "k"), (5, "http://q.b.org:80/", 1, "k"), (6, None, 1, "k"), (7, "", 1, "k"), (8, "http://c.example/", 4, "k"), (9, "http://a.example", None, "k")]
    df = spark.createDataFrame(captures, "id long, url string, fetched_at int, key string")
    ch = spark.createDataFrame(changes, "list_name string, scope string, key string, changed_at int, action string")
    got = sorted((r.id, r.matched_lists, r.n_matches, r.blocked, r.key) for r in U.evaluate(df, ch).collect())
    assert got == sorted([(1, ["l", "m"], 2, True, "k"), (2, [], 0, False, "k"), (3, [], 0, False, "k"), (4, ["l"], 1, True, "k"), (5, ["m"], 1, True, "k"), (5, ["m"], 1, True, "k"), (6, [], 0, False, "k"), (7, [], 0, False, "k"), (8, [], 0, False, "k"), (9, [], 0, False, "k")])
    assert U.evaluate(df.limit(0), ch).count() == 0
    assert not any(r.blocked for r in U.evaluate(df, ch.limit(0)).collect())


def test_hot_keys_and_clashing_columns(spark):
    changes = [("l", "host", "hot.example", 5, "add"), ("m", "domain", "hot.example", 7, "add"), ("l", "domain", "firm.co.uk", 0, "add")]
    ch = spark.createDataFrame(changes, "list_name string, scope string, key string, changed_at int, action string")
    captures = [("http://hot.example/a", 6, i, "x") for i in range(500)] + [("http://hot.example/a", 6, 7, "x")] * 500 + [("http://www.shop.firm.co.uk/", 1, -1, "x"), ("http://other.co.uk/", 1, -2, "x")]
    df = spark.createDataFrame(captures, "url string, fetched_at int, salt int, blocked string").withColumns({"url_key": F.lit("q"), "row": F.lit(1), "spans": F.lit(2)})
    out = U.evaluate(df, ch, captures_a_task=100)
    assert sorted(out.columns) == sorted([*df.columns, "matched_lists", "n_matches"])
    got = out.collect()
    assert len(got) == len(captures) and all(r.matched_lists == ["l"] and r.blocked for r in got if r.salt >= 0)
    assert {r.salt: r.blocked for r in got if r.salt < 0} == {-1: True, -2: False} and {(r.url_key, r.row, r.spans) for r in got} == {("q", 1, 2)}


def test_native(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", 1)], "id long, url string, fetched_at int")
    ch = spark.createDataFrame([], "list_name string, scope string, key string, changed_at int, action string")
    plan = U.evaluate(df, ch)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
