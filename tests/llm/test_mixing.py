import random

import pytest

from docloom.llm import mixing as X


@pytest.mark.parametrize("seed", range(8))
def test_less_than_one_block_off(seed):
    rng = random.Random(seed)
    period = rng.choice([10, 100, 997])
    share = X.shares({f"s{i}": rng.random() + 0.01 for i in range(rng.randrange(1, 9))}, period)
    assert sum(share.values()) == period and min(share.values()) > 0
    got = dict.fromkeys(share, 0)
    for t, s in enumerate(X.pattern(share, period), 1):
        got[s] += 1
        assert all(abs(got[x] * period - share[x] * t) < period for x in share)


def test_many_sources():
    weights = {f"s{i}": float(i + 1) for i in range(1200)} | {None: 3.0, "": 2.0}
    period = X.period_for(len(weights))
    share = X.shares(weights, period)
    assert period == 5000 and sum(share.values()) == period and min(share.values()) == 1
    sched = X.pattern(share, period)
    assert {s: sched.count(s) for s in (None, "", "s3", "s1199")} == {s: share[s] for s in (None, "", "s3", "s1199")}


def brute(rows, share, block, period):
    sched = X.pattern(share, period)
    out = []
    for source in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, 0))
        at, slots = 0, [i for i, s in enumerate(sched) if s == source] or [period - 1]
        for r in own:
            b = at // block
            out.append((r[0], source, b, b // len(slots) * period + slots[b % len(slots)]))
            at += len(r[2] or "")
    return sorted(out, key=str)


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None, ""]), "x" * rng.randrange(300)) for i in range(3000)] + [(None, "a", "yy"), (5000, "b", None), (6000, "b", "z" * 5000), (6001, "b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"hot": 0.5, "a": 0.3, "b": 0.15, None: 0.03, "": 0.02}
    got = X.schedule(df, weights, 1000, 100).select("doc_id", "source", "block", "slot").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, X.shares(weights, 100), 1000, 100)
    mixed = X.mix(df, weights, 1000, 100)
    assert mixed.columns == df.columns and sorted(map(tuple, mixed.collect()), key=str) == sorted(rows, key=str)
    slot = {(r.doc_id, r.source): r.slot for r in X.schedule(df, weights, 1000, 100).collect()}
    order = [slot[r.doc_id, r.source] for part in mixed.rdd.glom().collect() for r in part]
    assert order == sorted(order)
    assert X.schedule(df.limit(0), {}).count() == 0 and X.root_weights(df.limit(0)) == {} and X.mix(df.limit(0), {}).count() == 0
    assert X.schedule(df, {"hot": 1.0}).count() == len(rows)
    twice = df.union(df.filter("doc_id < 10"))
    assert X.schedule(twice, X.root_weights(twice)).count() == len(rows) + 10 and X.mix(twice, X.root_weights(twice)).count() == len(rows) + 10


def test_text_ids_and_clashing_columns(spark):
    rows = [(f"d{i}", "a", "word " * i, 5, i, "k") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id string, source string, text string, slot int, block int, row string")
    assert sorted(map(tuple, X.mix(df, {"a": 1.0}, 100, 10).collect())) == sorted(rows)
