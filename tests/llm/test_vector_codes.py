import math
import random

import numpy as np
import pytest

from docloom.llm import vector_codes as V

FORM = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=6, parts=8, entries=16):
    """Plain Lloyd on Python numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // parts))
    ints = [[max(-(2**26), min(2**26, math.floor(4096 * float(np.float32(x))))) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(book))

    for k in range(rounds + 1):
        at = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
        if k == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[p] for v, a in zip(cut, at) if a[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    total = {}
    for r, a in zip(kept, at):
        total[r[2]] = total.get(r[2], 0) + sum(d for d, _ in a)
    import hashlib

    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a), total[r[2]], digest) for r, a in zip(kept, at)), key=str)


def got(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(rows, FORM).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, V.op13_vector_codes(spark, path).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_lloyd(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_BYTES", 4 * 8 * 3 * 16)
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(24)] for _ in range(5)]
    rows = [(i * 3 % 251, [float(np.float32(round(c + rng.gauss(0, 0.2), 2))) for c in rng.choice(centres)], rng.choice([None, 1, 1, 2])) for i in range(160)]
    rows += [(9, [0.5] * 24, 1)] * 4 + [(700, None, 1), (701, [None] + [0.0] * 23, 2), (702, [float("nan")] * 24, 2), (703, [float("inf")] * 24, None), (None, [0.25] * 24, None)]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_few_short_and_large(spark, tmp_path):
    rows = [(1, [], 1), (2, [3e38, -3e38], 1), (3, [0.1] * 11, None), (4, [0.1] * 11, None)]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_empty(spark, tmp_path):
    assert got(spark, [(1, None, 1)], tmp_path) == []


def test_bounds_skip_work_and_change_nothing():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(4000, 8, 8)) * 300 + rng.integers(-2, 3, (4000, 1, 1)) * 4000).astype(np.int32)
    books = V.started(np.ascontiguousarray(x[:16].transpose(1, 0, 2), np.int64))
    codes, bounds = np.zeros((len(x), 8), np.uint8), np.full((len(x), 8, books.drift.shape[1]), -np.inf, np.float32)
    for k in range(6):
        codes, error, bounds, work = V.assign(x, books, codes, bounds)
        far = ((x[:, :, None].astype(np.int64) - books.entries[None]) ** 2).sum(3)
        assert (far.argmin(2) == codes).all() and (far.min(2).sum(1) == error).all()
        assert k == 0 or work < far.size * 0.6
        books = V.moved(books, V.sums_of(x, codes, 16))


def test_many_labels(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 7 if i % 5 else None, "", i) for i in range(100)], "vec_id long, label int, code string, error long")
    want = sorted(map(tuple, V.label_errors(rows).collect()), key=str)
    monkeypatch.setattr(V, "BROADCAST_LABELS", 2)
    assert sorted(map(tuple, V.label_errors(rows).collect()), key=str) == want
