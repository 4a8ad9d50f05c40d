import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe
from docloom.llm import packing as P


@pytest.mark.parametrize("seed", range(6))
def test_sequences_are_full_and_even(seed):
    rng = np.random.default_rng(seed)
    size = 64
    lengths = rng.integers(1, size, rng.integers(1, 400))
    got = P.balanced(lengths, size, 16)
    room = P.rooms(int(lengths.sum()), size)
    assert room.sum() == lengths.sum() and all(r == size or r & (r - 1) == 0 for r in room)
    seen = [np.zeros(n, int) for n in lengths]
    filled = [np.zeros(n, int) for n in room]
    for piece, start, length, at, offset in got:
        seen[piece][start : start + length] += 1
        filled[at][offset : offset + length] += 1
    assert all((x == 1).all() for x in seen) and all((x == 1).all() for x in filled)
    assert len(got) <= len(lengths) + len(room)


def test_lowest_cost_with_room():
    """The order of assignment, step by step, against a plain loop."""
    lengths = np.array([5, 9, 2, 9, 4, 3, 16, 1, 15])
    got = P.balanced(lengths, 16, 8)
    spent, room = {}, dict(enumerate(P.rooms(int(lengths.sum()), 16)))
    for piece, start, length, at, _ in got:
        if start == 0 and length == lengths[piece]:
            free = [(spent.get(s, 0), s) for s, r in room.items() if r >= length]
            assert (spent.get(at, 0), at) == min(free)
        spent[at] = spent.get(at, 0) + length + length * length / 8
        room[at] -= length


def test_costs_agree_more_than_by_first_fit():
    rng = np.random.default_rng(0)
    lengths = np.minimum(300, rng.lognormal(4, 1, 4000).astype(int) + 1)
    spent = np.zeros(len(P.rooms(int(lengths.sum()))))
    for _, _, length, at, _ in P.balanced(lengths):
        spent[at] += P.cost(np.array(length))
    whole = spent[: lengths.sum() // P.SEQUENCE]
    room, plain = np.full(len(whole) * 2, P.SEQUENCE), np.zeros(len(whole) * 2)
    for n in sorted(lengths, reverse=True):
        at = int((room >= n).argmax())
        room[at] -= n
        plain[at] += P.cost(np.array(n))
    plain = plain[room < 32]
    assert whole.std() / whole.mean() < 0.5 * plain.std() / plain.mean()


def test_documents(spark):
    rng = random.Random(3)
    words = ["data", "Straße", "naïve ", "\n\n", "x" * 40, "日本", "<|endoftext|>", "  ", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 7, 60, 900])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id"), (502, "ab " * 30000), (502, "ab " * 30000), (503, "z" * 50000)] + [(7, rows[7][1])] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sequence_id", F.lit("other")).repartition(3)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.public_paths()[0])
    ids = {}
    for d, t in rows:
        ids[d] = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    got = P.pack(P.tails(df, bpe.public_paths())).collect()
    seen, sequences, n_docs = {}, {}, {}
    for d, _ in rows:
        n_docs[d] = n_docs.get(d, 0) + 1
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(piece.tobytes()) == r.ids_crc32
        seen.setdefault(r.doc_id, np.zeros(r.doc_tokens, int))[r.start : r.start + r.length] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    assert set(seen) == set(ids) and all((x == n_docs[d]).all() for d, x in seen.items())
    for parts in sequences.values():
        at = 0
        for offset, length, total in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= 1024 and at & (at - 1) == 0
    assert P.pack(P.tails(df.limit(0), bpe.public_paths())).count() == 0


def test_small_batches(spark, monkeypatch):
    df = spark.createDataFrame([(i, "one two three " * (i % 9)) for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(P, "BATCH_PIECES", 16)
    got = P.pack(P.tails(df, bpe.public_paths())).collect()
    ends = {}
    for r in got:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert all(n & (n - 1) == 0 and n <= 1024 for n in ends.values())
    assert sum(ends.values()) == sum({r.doc_id: r.doc_tokens for r in got}.values())
