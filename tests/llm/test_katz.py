import functools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import katz as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + ["</s>"]


class Brute:
    """The model by plain recursion over tuples of words."""

    def __init__(self, texts, order=2):
        seqs = [["<s>", *tokens(t)] for t in texts]
        self.one = Counter(w for s in seqs for w in s[1:])
        self.n, self.order = sum(self.one.values()), order
        self.grams = {k: Counter((tuple(s[i + 1 - k : i]), s[i]) for s in seqs for i in range(max(1, k - 1), len(s))) for k in range(2, order + 1)}
        self.after = {}
        for grams in self.grams.values():
            for h, w in grams:
                self.after.setdefault(h, []).append(w)
        times = lambda c: [0, *(sum(x == r for x in c.values()) for r in range(1, 7))]
        self.d = {1: L.discounts(times(self.one))} | {k: L.discounts(times(c)) for k, c in self.grams.items()}
        freed = sum((1 - self.d[1][min(c, 6)]) * c for c in self.one.values()) / self.n if self.n else 1.0
        self.unk = freed if freed > 0 else 1 / (self.n + len(self.one) + 1)
        self.scale = (1 - self.unk) / (1 - freed) if freed < 1 else 1.0

    def p1(self, w):
        c = self.one[w]
        return self.scale * self.d[1][min(c, 6)] * c / self.n if c else self.unk

    @functools.cache
    def weight(self, h):
        grams, d = self.grams[len(h) + 1], self.d[len(h) + 1]
        total = sum(grams[h, x] for x in self.after[h])
        freed = sum((1 - d[min(grams[h, x], 6)]) * grams[h, x] for x in self.after[h]) / total
        shrink = 1.0 if freed > 0 else total / (total + 1)
        return total, shrink, (freed if freed > 0 else 1 / (total + 1)) / (1 - sum(self.p(h[1:], x) for x in self.after[h]))

    def p(self, h, w):
        if not h:
            return self.p1(w)
        if h not in self.after:
            return self.p(h[1:], w)
        total, shrink, weight = self.weight(h)
        c = self.grams[len(h) + 1][h, w]
        return shrink * self.d[len(h) + 1][min(c, 6)] * c / total if c else weight * self.p(h[1:], w)

    def score(self, text):
        s = ["<s>", *tokens(text)]
        return sum(math.log10(self.p(tuple(s[max(0, i + 1 - self.order) : i]), s[i])) for i in range(1, len(s)))

    def base(self, text):
        return sum(math.log10((self.one[w] + 1) / (self.n + len(self.one) + 1)) for w in tokens(text))


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", *(f"w{i}" for i in range(120))]
    for i in range(n):
        k = rng.randrange(40)
        yield i, " ".join("the" if j % 2 and rng.random() < 0.7 else words[min(len(words) - 1, int(rng.expovariate(0.05)))] for j in range(k)) if rng.random() < 0.95 else rng.choice([None, "", "new unseen words"])


@pytest.mark.parametrize(("n", "order"), [(300, 2), (40, 2), (1, 2), (300, 1), (300, 3), (40, 3), (1, 3), (120, 4)])
def test_equals_plain_model(spark, n, order):
    rows = list(corpus(n, n))
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(2)
    got = {r.doc_id: r for r in L.score_documents(df, F.expr("doc_id % 5 = 1"), order=order).collect()}
    model = Brute([t for i, t in rows if i % 5 != 1], order)
    assert len(got) == n
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 1, len(tokens(t)), sum(model.one[w] > 0 for w in tokens(t)), model.n)
        assert r.base_score == pytest.approx(model.base(t), abs=1e-9)
        assert r.score == pytest.approx(model.score(t), abs=1e-7)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_sums_to_one(order):
    model = Brute([t for _, t in corpus(5, 200)], order)
    for h in [("<s>",), ("the",), ("w3",), ("w3", "the"), ("nowhere", "the"), ("nowhere",), ("<s>", "w1"), ("w1", "the", "w2")]:
        assert sum(model.p(h[-(order - 1) :], w) for w in model.one) + model.p(h[-(order - 1) :], "never seen") == pytest.approx(1)


def test_many_slices_and_hot_histories(spark, monkeypatch):
    """Slices of a few texts, and histories that are spread over all buckets on every level."""
    monkeypatch.setattr(L, "SLICE_BYTES", 400)
    rows = [(i, "the old word of the old word " * (i % 4) + (t or "")) for i, t in corpus(8, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, buckets, one, known, hot_from = L._prepared(df, F.lit(False), False)
    _, levels, _ = L._climbed(known, buckets, hot_from, one, 3)
    model = Brute([t for _, t in rows], 3)
    got = {r.doc_id: r.score for r in L.score_documents(df, F.lit(False), order=3).collect()}
    assert all(got[i] == pytest.approx(model.score(t), abs=1e-7) for i, t in rows)
    assert all(len(level.hot[0]) for level in levels)


def test_tables_and_edges(spark):
    df = spark.createDataFrame([(None, "a b a b"), (1, None), (1, "a b")], "doc_id long, text string")
    counts = L.gram_table(df, F.lit(False), order=3).collect()
    assert sorted(r["count"] for r in counts if r.level == 2) == [1, 1, 2, 2, 3]
    assert sorted(r["count"] for r in counts if r.level == 3) == [1, 1, 2, 2]
    numbers = {r.number for r in counts if r.level == 2}
    assert len(numbers) == 5 and {r.history for r in counts if r.level == 3} <= numbers
    for order in (1, 2, 3):
        assert L.score_documents(df, F.lit(True), order=order).count() == 3
        assert L.score_documents(df.limit(0), F.lit(False), order=order).count() == 0
    with pytest.raises(ValueError, match="order"):
        L.score_documents(df, F.lit(False), order=0)


def test_packing():
    for x in (np.arange(10, dtype=np.uint64), np.zeros(0, np.int64), np.array([1.5, -2])):
        assert L.unpack(L.pack(x), x.dtype.str).tolist() == x.tolist()
