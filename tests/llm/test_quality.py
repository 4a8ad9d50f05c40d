import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import ngrams as N
from docloom.llm import quality_classifier as C
from docloom.llm import quality_rules as Q
from docloom.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(wins)
    covered = {k for i, w in enumerate(wins) if n[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_counts(limit):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a\n", "a\na\n a\na", "é é\x0b# |", "x y z", "a b c d e a b c d e f", "a " * 40]
    texts += ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "🙂", "#"]) for _ in range(rng.randrange(120))) for _ in range(300)]
    got = []
    for _, _, buf, off in K.text_slices(pa.array(texts), limit):
        out = Q.rule_counts(buf, off)
        got += np.stack([out[c] for c in Q.COUNTS], 1).tolist()
    assert got == [brute(t) for t in texts]


def test_features_by_text():
    texts = ["one two three", "", "xy", "one two", "été 漢字 abc"]
    (_, _, buf, off), = K.text_slices(pa.array(texts))
    for kind in range(N.KINDS):
        ids, bounds = N.features(buf, off)[kind]
        for k, t in enumerate(texts):
            (_, _, b, o), = K.text_slices(pa.array([t]))
            assert ids[bounds[k] : bounds[k + 1]].tolist() == N.features(b, o)[kind][0].tolist()


def corpus(n, seed=1):
    rng = random.Random(seed)
    syll = ["an", "the", "or", "ti", "re", "on", "ea", "st"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randrange(1, 4)))
    for i in range(n):
        words = [word() for _ in range(rng.randrange(12, 80))]
        bad = rng.random() < 0.25
        yield i, " ".join(w + rng.choice(["###", "&&&", "$$$"]) if bad and rng.random() < 0.8 else w for w in words), int(not bad)


def test_models(spark):
    rows = list(corpus(800))
    docs = spark.createDataFrame([(i, t, "k") for i, t, _ in rows] + [(None, None, "k"), (9001, "", "k"), (0, rows[0][1], "k")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    truth = {i: q for i, _, q in rows}
    got = Q.judge(docs, Q.train(docs, labels)).collect()
    assert len(got) == 803
    assert np.mean([r.kept == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.97
    assert not any(r.kept for r in got if r.n_words < 10)
    kept = Q.keep(docs, Q.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    held = set(range(0, 800, 4))
    model = C.fit(N.labelled_sample(docs, labels.filter("doc_id % 4 != 0"), "quality", 500))
    scored = C.score(docs, model).collect()
    assert len(scored) == 803 and all(0 <= r.score <= 1 for r in scored)
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in scored if r.doc_id in held]) > 0.97
    assert len({round(r.score, 12) for r in scored if r.doc_id == 0}) == 1


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in Q.judge(docs, Q.train(docs, labels)).collect()} == {1: True, 2: False}
    assert C.score(docs, C.fit(N.labelled_sample(docs, labels, "quality", 10))).count() == 2
    assert Q.judge(docs.limit(0), Q.train(docs, labels)).count() == 0


def small_sample(seed, texts=24, features=40):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(texts):
        ids = np.sort(rng.choice(features, rng.integers(3, 15), replace=False))
        rows.append((int(k % 3 == 0), ids, rng.integers(1, 4, len(ids))))
    return rows


def test_dual_descent_against_a_plain_loop():
    """The same steps in plain Python; in the end the duality gap is closed and the margins are those of the definition."""
    rows = small_sample(1)
    ids, values = [r[1] for r in rows], [r[2] / np.linalg.norm(r[2]) for r in rows]
    signs, limits = np.array([1.0 if r[0] else -1.0 for r in rows]), np.full(len(rows), 1.0)
    w, b, dual = C.descend(ids, values, signs, limits, rounds=400, features=40)
    plain, pb, alpha, order = [0.0] * 40, 0.0, [0.0] * len(rows), np.random.default_rng(7)
    for _ in range(400):
        for i in order.permutation(len(rows)):
            g = signs[i] * (sum(plain[f] * v for f, v in zip(ids[i], values[i])) + pb) - 1
            new = min(1.0, max(0.0, alpha[i] - g / (sum(v * v for v in values[i]) + 1.0)))
            for f, v in zip(ids[i], values[i]):
                plain[f] += (new - alpha[i]) * signs[i] * v
            pb += (new - alpha[i]) * signs[i]
            alpha[i] = new
    assert np.allclose(w, plain) and abs(b - pb) < 1e-9
    margins = np.array([signs[i] * (w[ids[i]] @ values[i] + b) for i in range(len(rows))])
    primal = 0.5 * (w @ w + b * b) + (limits * np.maximum(0, 1 - margins)).sum()
    assert 0 <= primal - (dual.sum() - 0.5 * (w @ w + b * b)) < 1e-3 * primal


def test_ratio_model_against_a_plain_loop():
    rows = small_sample(2, 60)
    model = C.fit(N.Sample.of(list(rows)))
    train = [r for k, r in enumerate(rows) if k % 4 != 3]
    seen = {c: [1.0 + sum(f in r[1] for r in train if r[0] == c) for f in range(40)] for c in (0, 1)}
    rest = N.FEATURES - 40
    ratio = [np.log(seen[1][f] / (sum(seen[1]) + rest)) - np.log(seen[0][f] / (sum(seen[0]) + rest)) if seen[0][f] + seen[1][f] - 2 >= 3 else 0.0 for f in range(40)]
    assert np.allclose(np.sqrt(model.square[:40]), np.abs(ratio)) and not model.square[40:].any()


def test_logistic_fit_against_a_plain_loop():
    rows = small_sample(3, 40)
    model = Q.fit(N.Sample.of(list(rows)), steps=15, least_texts=1)
    train = [k for k in range(len(rows)) if k % 4 != 3]
    y = [r[0] for r in rows]
    share = {k: 0.5 / sum(y[j] == y[k] for j in train) for k in train}
    x = [{int(f): c / sum(r[2]) for f, c in zip(r[1], r[2])} for r in rows]
    w, past, b, bias_past = [0.0] * 40, [0.0] * 40, 0.0, 0.0
    for _ in range(15):
        pull = {k: (1 / (1 + np.exp(-(b + sum(w[f] * v for f, v in x[k].items())))) - y[k]) * share[k] for k in train}
        grad = [sum(pull[k] * x[k].get(f, 0.0) for k in train) + 1e-6 * w[f] for f in range(40)]
        past = [p + g * g for p, g in zip(past, grad)]
        w = [v - 2.0 * g / (np.sqrt(p) + 1e-9) for v, g, p in zip(w, grad, past)]
        bias_past += sum(pull.values()) ** 2
        b -= 2.0 * sum(pull.values()) / (np.sqrt(bias_past) + 1e-9)
    assert np.allclose(model.weights[:40], w, atol=1e-3) and abs(model.bias - b) < 1e-3 and not model.weights[40:].any()


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(30)] + [(99, "long " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(30), 99]], "doc_id long, quality int")
    assert len(N.labelled_sample(docs, labels, "quality", 100, 1_000).y) == 10
    assert len(N.labelled_sample(docs, labels, "quality", 100).y) == 31
