import random
import re
import zlib
from collections import Counter

import pytest

from docloom.llm import spelling as S


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    form, near = {}, {}
    for w, n in words.items():
        own = [x for x in words if one_apart(w, x)]
        near[w] = len(own)
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_against_every_pair(spark, seed):
    rng = random.Random(seed)
    letters = "abcé"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7]))) for _ in range(250)]
    words += ["straße", "strasse", "×÷ÿaaaa", "aaaaaaa", "aaaaaa", "aaaaaaaa", "abababab", "babababa"]
    rows = []
    for i in range(900):
        pick = [rng.choice(words) if rng.random() < 0.5 else words[min(int(rng.expovariate(0.05)), len(words) - 1)] for _ in range(40)]
        rows.append((i if i % 50 else None, rng.choice([" ", "-", "1", "ŁĀ"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in pick)))
    rows += [(1, None), (2, ""), (3, "1234 ÀÉ")] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = brute(rows)
    got = S.grouped(df)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[1] for r in want)


def test_chains(spark):
    """Roots over chains of many forms; counts are given, so that the chain is long."""
    names = ["a" * 6 + "b" * k for k in range(1, 12)]
    rows = [(w, 5**k) for k, w in enumerate(names)] + [("zzzzzzz", 7)]
    found = S.forms(spark.createDataFrame(rows, "word string, n long"))
    links = dict(map(tuple, S.roots(found).collect()))
    assert links == {w: names[-1] for w in names[:-1]}
    assert {r.word: r.n_near for r in found.collect()} == {w: (1 if w in (names[0], names[-1]) else 2) for w in names} | {"zzzzzzz": 0}


def test_each_pair_comes_once(spark):
    rows = [(w, 1) for w in ("ababab", "bababa", "aababab", "abbabab", "abaab", "aabbaa", "aabaa", "abbaa", "aaabaa", "cababab")]
    got = [(r.word, r.near) for r in S.near_pairs(spark.createDataFrame(rows, "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, _ in rows for b, _ in rows if a != b and one_apart(a, b)}


def test_empty(spark):
    assert S.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0
