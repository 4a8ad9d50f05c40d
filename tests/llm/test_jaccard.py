import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import components as C
from docloom.llm import jaccard_join as J
from docloom.llm import textkernel as K
from docloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def family(rng, words, n, rate):
    for _ in range(n):
        yield " ".join(rng.choice(["x", "y", "z"]) if rng.random() < rate else w for w in words)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(70)]
    texts = [None, "", " \n", "One two", "one  TWO", "one", "a b c d e", "A b c d e"]
    for length in (4, 6, 9, 14, 30, 63, 68, 75, 90, 130, 150, 270, 300, 600):
        base = [word() for _ in range(length)]
        texts += family(rng, base, 6, 0.03) if length > 20 else [*family(rng, base, 4, 0.1), " ".join(base), " ".join(base[:-1]), " ".join([*base, "q"])]
        texts += [" ".join(base), " ".join(base), " ".join(base[: length * 9 // 10]), " ".join([*base, *(word() for _ in range(length // 8))])]
        texts += [" ".join(passage + [word() for _ in range(length)]) for _ in range(3)]
    texts += family(rng, [word() for _ in range(260)], 40, 0.012)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join_documents(df).collect())
    assert got == brute(rows)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


def test_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (5, t), (5, t), (None, None), (7, t + " more"), (8, "other words stand in this text here"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_shingles, (r.component_id or 0)) for r in J.join_documents(df).collect())
    assert got == [(0, 0, 0), (0, 36, 5), (5, 36, 5), (5, 36, 5), (7, 37, 5), (8, 0, 8), (8, 3, 8)]
    assert sorted(((r.doc_id or 0), r.text or "") for r in J.keep_one(df).collect()) == [(0, ""), (5, t), (8, ""), (8, rows[5][1])]
    assert J.join_documents(df.limit(0)).count() == 0 and J.keep_one(df.limit(0)).count() == 0


def test_every_link_is_asked(monkeypatch):
    """Linked sets of any sizes meet in a listed value that the smaller one asks with, or it goes against all."""
    rng = np.random.default_rng(5)
    alone = 0
    for _ in range(600):
        s = int(rng.integers(1, 400))
        l = int(rng.integers(s, 5 * s // 4 + 1))
        least = -(-4 * (s + l) // 9)
        both = int(rng.integers(least, s + 1)) if least <= s else s
        u = rng.integers(0, 2**64, l + s - both, dtype=np.uint64)
        x, y = np.sort(u[:s]), np.sort(u[s - both :])
        tv, vals, stuck = J.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        mine = {v for t, v in zip(tv.tolist(), vals.tolist(), strict=True) if t & (J.ASKS - 1) == 0 and t & J.ASKS}
        theirs = {v for t, v in zip(tv.tolist(), vals.tolist(), strict=True) if t & (J.ASKS - 1) == 1}
        assert mine & theirs or 0 in stuck.tolist()
        alone += 0 in stuck.tolist()
    assert alone < 60


def test_against_all(spark, monkeypatch):
    """Sets that can't ask enough are found all the same."""
    real = J.signatures

    def all_stuck(sets, bounds):
        text, value, _ = real(sets, bounds)
        return text & ~J.ASKS, value, np.flatnonzero(np.diff(bounds) > 0)

    monkeypatch.setattr(J, "signatures", all_stuck)
    rows = corpus(3)[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(J)
    try:
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join_documents(df).collect()) == brute(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(J)


def test_histograms_bound_the_difference():
    (_, _, buf, off), = K.text_slices(pa.array(["a b c d e f g h i j k", "a b c d e f g h i j z z z"]))
    sets, bounds = J.shingle_sets(buf, off)
    h = [J.folded(x, 64) for x in J.histograms(sets, bounds)]
    assert np.abs(h[0] - h[1]).sum() <= len(set(sets[: bounds[1]]) ^ set(sets[bounds[1] :]))
    many = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    (big,) = J.histograms(many, np.array([0, 3000]))
    assert len(big) == 2048 and J.folded(big, 64).sum() == 3000


def test_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, 100)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, i // 20 * 20) for i in range(60)}


@pytest.mark.parametrize("most", [0, 200_000])
def test_components_after_further_links(spark, monkeypatch, most):
    """Links that come in parts give the least node of each component, as all of them at once do."""
    monkeypatch.setattr(C, "BROADCAST_NODES", most)
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    parts = [links[:100], links[100:130] * 2, [], links[130:]]
    frame = lambda part: spark.createDataFrame(part, "a long, b long")
    roots, n = C.grouped(frame(parts[0]))
    for k in range(1, 4):
        roots, n = C.merged(roots, n, frame(parts[k]))
        root = {x: x for ab in links for x in ab}
        for _ in root:
            for a, b in sum(parts[: k + 1], []):
                root[a] = root[b] = min(root[a], root[b])
        linked = {x for a, b in sum(parts[: k + 1], []) if a != b for x in (a, b)}
        got = [(r.node, r.root) for r in roots.collect()]
        assert sorted(got) == sorted((x, root[x]) for x in linked) and n >= len(got)


def ran(spark, job):
    """The tasks that ran for a job."""
    store = spark.sparkContext._jsc.sc().statusStore()
    count = lambda: sum(store.executorList(False).apply(i).completedTasks() for i in range(store.executorList(False).size()))
    wait = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    wait()
    before = count()
    job()
    wait()
    return count() - before


def test_few_shuffles(spark):
    """Each shuffle has files for all its tasks, however few rows there are: on check_h these filled the disk."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.createDataFrame(corpus(1), "doc_id long, text string").repartition(3)
        tasks = ran(spark, lambda: J.join_documents(df).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tasks < 1250


def test_large_families_meet_in_blocks(spark, monkeypatch):
    """A family above one block: groups stay small, and each pair in two components meets."""
    monkeypatch.setattr(J, "GROUP_BYTES", 4000)
    names = [i.to_bytes(16, "big") for i in range(200)]
    rows = [(v, names[i], v == 0 or i % 3 == 0, names[0]) for i in range(200) for v in range(5)]
    member = spark.createDataFrame(rows, "val long, node binary, asks boolean, least binary")
    classes = spark.createDataFrame([(x, 100, bytes(64)) for x in names], "node binary, n_shingles long, histogram binary")
    for apart in (4, 120):
        roots = spark.createDataFrame([(x, names[0]) for x in names[:-apart]], "node binary, root binary")
        nodes, plan = J._families(member, roots, classes)
        for nearest in (False, True):
            groups, sent = {}, 0
            for r in J._groups(nodes, plan, nearest, 1).collect():
                groups.setdefault((r.i, r.j), []).append((int.from_bytes(r.node, "big"), r.side))
                sent += 1
            assert max(map(len, groups.values())) <= 0.4 * len(names)
            met = {(min(x, y), max(x, y)) for g in groups.values() for x, s in g if s & 1 for y, t in g if t & 2}
            if not nearest or apart == 4:
                assert met >= {(x, y) for y in range(200 - apart, 200) for x in range(y)}
            else:
                assert sent <= 2 * len(names)


def test_components_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP_BYTES", 15_000)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(260)]
    rows = list(enumerate([*family(rng, words, 30, 0.012), *family(rng, words, 30, 0.03)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join_documents(df).collect()) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_frequent_values_are_those_of_many_sets(seed):
    rng = np.random.default_rng(seed)
    n = (0, 1, 300, 4000)[seed]
    text = rng.integers(0, 40, n)
    value = rng.integers(0, 60, n).astype(np.uint64)
    owners = {}
    for t, v in zip(text.tolist(), value.tolist(), strict=True):
        owners.setdefault(v, set()).add(t)
    many, stands = J.frequent(text | rng.integers(0, 4, n) << 14, value)
    assert many.tolist() == [len(owners[v]) > J.PAIRS_UP_TO for v in value.tolist()]
    assert sorted(value[stands].tolist()) == sorted(v for v, o in owners.items() if len(o) > J.PAIRS_UP_TO)
