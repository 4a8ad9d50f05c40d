"""Language-model scores by Katz backoff.

``P(w | v) = d c(v w) / c(v)`` for grams seen in training, else ``a(v) P(w | v')`` with v' the history without its first
word, by recursion down to ``P(w) = d c(w) / N`` for known words; the mass that discounting frees there goes to one unknown word. Discounts are Good-Turing's for counts up to
5 (an absolute discount where its estimates are not decreasing), the weights ``a(v)`` normalise exactly over the
vocabulary and the unknown word. A word's history is the order - 1 words before it, of which the start of the text is
one; a word with fewer before it has the chance of a lower order. Each text ends with an end token. Words are compared by 64-bit hashes.

The corpus is worked on in slices. A slice's distinct words go to buckets by hash, which sum training counts,
number the words (frequent ones low) and answer; then, level by level, its distinct grams go to buckets by history, which
sum and answer with counts, what a history's weight is made of, and the grams' numbers, which are the histories of the next
level. A history with more than a small share of all
tokens is spread over all buckets by its second words; there are few such histories by that very definition, so
their sums are a small table of ``HOT_WORDS`` rows at most. A task holds
one slice or one bucket; the number of buckets follows the input. The corpus is cut into slices more than once, and alike each
time: the input is a stored table (others are stored first) whose splits are held for the session, so that executors which come
or go change nothing. ``gram_table`` writes the model's counts as a table by levels and buckets.

A null text is empty: it has only the end token. Repeated rows count as often as they stand there. With no
training row all words are unknown. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkernel as K
from docloom.llm.ngrams import segment_sums
from docloom.llm.tables import checkpointed, crc_bucket, table, written
from docloom.sources.shared import new_folder

SLICE_BYTES = 10 << 20
BUCKET_BYTES = 16 << 20
#: So many words at most may be spread over all buckets; their sums (64 bytes each) are broadcast.
HOT_WORDS = 1 << 20
DISCOUNTED = 5
HELD_OUT_OF, HELD_OUT = 7, 2
END = np.uint64(0x0E9D0E9D0E9D0E9D)
START_ID = np.uint64(1) << np.uint64(62)
#: Kinds of rows beside texts (0), words (1) and the levels' grams (2 to 7): parts of hot histories, sums of a bucket.
HOT, SUMS = 8, 9
NEEDED = "chunk long, kind int, bucket int, a binary, b binary, c binary"


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, like bytes of its items together."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b"")


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


class Slice:
    """Tokens of some texts: local word numbers (by bucket, then falling counts), with an end token after each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, buckets: int):
        starts, ends, bounds = K.word_spans(buf, offsets)
        words = K.span_hashes(K.LOWER[buf], starts, ends)
        texts = len(bounds) - 1
        self.bounds = bounds + np.arange(texts + 1)
        hashes = np.full(len(words) + texts, END, np.uint64)
        inside = np.ones(len(hashes), bool)
        inside[self.bounds[1:] - 1] = False
        hashes[inside] = words
        known, local = np.unique(hashes, return_inverse=True)
        bucket = (known >> np.uint64(8)) % np.uint64(buckets)
        order = np.lexsort((known, -np.bincount(local), bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.tokens = known[order], place[local].astype(np.uint32)
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        # a word's code: its place in its bucket, frequent ones first, then the bucket; so frequent words have small codes
        codes = (place - self.cuts[bucket.astype(np.int64)]) * buckets + bucket.astype(np.int64)
        self.codes = codes[local].astype(np.uint64 if buckets > 4096 else np.uint32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that reach ``SLICE_BYTES`` of text, whatever Spark's own batches are."""
    held: list[pa.RecordBatch] = []
    size = 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size >= SLICE_BYTES:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def _slices(batches: Iterator[pa.RecordBatch], buckets: int):
    """(name, first row, end row, batch, slice). A name is a hash of place and content, so that two passes that cut
    the corpus in different ways can't be mistaken for one another."""
    place = 0
    for batch in _gathered(batches):
        for lo, hi, buf, offsets in K.text_slices(batch.column(1), 2 * SLICE_BYTES):
            name = hashlib.blake2b(buf.tobytes(), digest_size=8, key=f"{batch.column(3)[0].as_py()}:{place}".encode()).digest()
            yield int.from_bytes(name, "little", signed=True), lo, hi, batch, Slice(buf, offsets, buckets)
            place += 1


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0 to DISCOUNTED + 1 and above, from the numbers n[r] of items seen r times."""
    k = DISCOUNTED
    d = np.ones(k + 2)
    if n[1] and all(n[r] for r in range(1, k + 2)):
        common = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            d[r] = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if common != 1 else 2.0
    else:
        d[1:] = 2.0
    if not all(0 < d[r] < 1 for r in range(1, k + 1)):
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = np.array([1.0, *[1 - cut / r for r in range(1, k + 1)], 1.0])
    return d


class Unigrams:
    """Probabilities by training count; one unknown word has the mass that is left."""

    def __init__(self, tokens: int, types: int, n: list[int]):
        self.tokens, self.types = tokens, types
        self.d = discounts(n)
        freed = sum((1 - self.d[r]) * r * n[r] for r in range(1, DISCOUNTED + 1)) / tokens if tokens else 1.0
        self.unknown = freed if freed > 0 else 1 / (tokens + types + 1)
        self.scale = (1 - self.unknown) / (1 - freed) if freed < 1 else 1.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        p = self.scale * self.d[np.minimum(counts, DISCOUNTED + 1)] * counts / max(1, self.tokens)
        return np.where(counts > 0, p, self.unknown)


def _word_requests(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for number, lo, hi, batch, s in _slices(batches, buckets):
            train = ~np.repeat(batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool), np.diff(s.bounds))
            counts = np.bincount(s.tokens[train], minlength=len(s.words)).astype(np.uint32)
            rows = [(b, number, s.words[x:y].tobytes(), pack(counts[x:y])) for b, (x, y) in enumerate(zip(s.cuts[:-1], s.cuts[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "a", "b"])

    return docs.mapInArrow(run, "bucket int, chunk long, a binary, b binary")


def _word_answers(requests: DataFrame, buckets: int) -> DataFrame:
    """For each request the words' numbers (0: unknown) and counts; and one row of sums for each bucket."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        words = [np.frombuffer(x, np.uint64) for x in rows.column("a").to_pylist()]
        counts = [unpack(x, "u4") for x in rows.column("b").to_pylist()]
        known, where = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts), len(known)).astype(np.int64)
        number = np.zeros(len(known), np.uint64)
        order = np.argsort(-total, kind="stable")
        number[order] = np.arange(len(known), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)
        number[total == 0] = 0
        chunks, at, out = rows.column("chunk").to_pylist(), 0, []
        for chunk, w in zip(chunks, words, strict=True):
            own = where[at : at + len(w)]
            out.append((chunk, 1, bucket, pack(number[own]), pack(total[own]), None))
            at += len(w)
        sums = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()]
        out.append((None, 9, bucket, np.array(sums, np.int64).tobytes(), None, None))
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["chunk", "kind", "bucket", "a", "b", "c"])

    return requests.groupBy("bucket").applyInArrow(run, NEEDED)


def _texts(docs: DataFrame, buckets: int) -> DataFrame:
    """One row of kind 0 for each slice: rows' ids and marks, bounds and tokens."""

    def run(batches):
        for number, lo, hi, batch, s in _slices(batches, buckets):
            rows = pa.table({"doc_id": batch.column(0).slice(lo, hi - lo), "held": batch.column(2).slice(lo, hi - lo)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([pack(np.diff(s.bounds))], pa.binary()), pa.array([pack(s.codes)], pa.binary())], ["chunk", "kind", "bucket", "a", "b", "c"])

    return docs.mapInArrow(run, NEEDED)


class Grams:
    """The distinct (history, word) of a slice's tokens on one level, by bucket, history, word."""

    def __init__(self, history: np.ndarray, size: np.ndarray, word: np.ndarray, lower: np.ndarray, buckets: int, hot_from: float):
        asked = np.flatnonzero(history > 0)
        v, w = history[asked], word[asked]
        hot = size[asked] > hot_from
        spread = np.where(hot, K.mix64(v ^ K.mix64(w)), K.mix64(v)) % np.uint64(buckets)
        order = np.lexsort((w, v, spread))
        new = np.concatenate([[True], (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])]) if len(order) else np.zeros(0, bool)
        pick = order[new]
        self.gram = np.full(len(word), -1, np.int64)
        self.gram[asked[order]] = np.cumsum(new) - 1
        self.v, self.w, self.lower, self.hot = v[pick], w[pick], lower[asked[pick]], hot[pick]
        self.cuts = np.searchsorted(spread[pick], np.arange(buckets + 1))

    def histories(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one bucket: distinct histories, their run lengths, and whether they are hot."""
        v, hot = self.v[self.cuts[b] : self.cuts[b + 1]], self.hot[self.cuts[b] : self.cuts[b + 1]]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        return v[first], np.diff(np.append(first, len(v))), hot[first]


class Level:
    """What a slice needs of a level whose grams are counted: its discounts and its hot histories with their sums."""

    def __init__(self, d: np.ndarray, hot: tuple[np.ndarray, np.ndarray]):
        self.d, self.hot = d, hot


class Tokens:
    """A slice's tokens with their words' numbers and counts, and, by recursion over the levels, their chances.

    Level k's history of a token is the number of the gram of level k - 1 that ends before it (on level 2 a word's
    number, or the start of the text); its chance is that gram's discounted share where it was seen in training, else
    the history's weight times the chance on level k - 1.
    """

    def __init__(self, rows: pa.Table, buckets: int, hot_from: float, one: Unigrams):
        rows = rows.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = rows.column("kind").to_pylist()
        self.answers = [r for r in rows.to_pylist() if r["kind"] > 1]
        if kinds[0] != 0 or 1 not in kinds:
            raise RuntimeError("the input changed between two passes")
        (first,) = rows.slice(0, 1).to_pylist()
        self.rows = pa.ipc.open_stream(first["a"]).read_all()
        self.bounds = np.concatenate([[0], np.cumsum(unpack(first["b"], "i8"))])
        codes = unpack(first["c"], "u8" if buckets > 4096 else "u4").astype(np.int64)
        parts = rows.slice(1, kinds.count(1)).to_pylist()
        each = [unpack(r["a"], "u8") for r in parts]
        start = np.zeros(buckets, np.int64)
        start[[r["bucket"] for r in parts]] = np.cumsum([0, *map(len, each)])[:-1]
        tokens = start[codes % buckets] + codes // buckets
        numbers = np.concatenate(each)
        counts = np.concatenate([unpack(r["b"], "i8") for r in parts])
        self.word, self.count = numbers[tokens], counts[tokens]
        self.buckets, self.hot_from, self.one = buckets, hot_from, one
        self.number, self.size, self.chance, self.level = self.word, self.count, one(self.count), 1

    def grams(self) -> Grams:
        """The grams of the next level."""
        history, size = np.zeros_like(self.word), np.zeros(len(self.word), np.int64)
        history[1:], size[1:] = self.number[:-1], self.size[:-1]
        history[self.bounds[:-1]], size[self.bounds[:-1]] = (START_ID, 1 << 60) if self.level == 1 else (0, 0)
        lower = self.count if self.level == 1 else self.chance  # words' counts take less room than their chances
        return Grams(history, size, self.word, lower, self.buckets, self.hot_from)

    def climb(self, levels: list[Level]) -> None:
        """Chances, numbers and counts of the next levels, from the answers to their grams."""
        for known in levels:
            g = self.grams()
            self.level += 1
            self.number, self.size = np.zeros_like(self.word), np.zeros(len(self.word), np.int64)
            answers = [r for r in self.answers if r["kind"] == self.level]
            if not answers:
                continue
            count = np.concatenate([unpack(r["a"], "i8") for r in answers])
            sums, runs = [], []
            for r in answers:
                v, lengths, is_hot = g.histories(r["bucket"])
                own = np.concatenate([unpack(r["b"], "u4").reshape(-1, len(v)).astype(np.float64), unpack(r["c"], "f8")[None]]).T.copy()
                words, totals = known.hot
                own[is_hot] = totals[np.searchsorted(words, v[is_hot].astype(np.int64))]
                sums.append(own)
                runs.append(lengths)
            sums, runs = np.concatenate(sums), np.concatenate(runs)
            total = sums[:, 0]
            freed = ((1 - known.d[1 : DISCOUNTED + 1]) * np.arange(1, DISCOUNTED + 1) * sums[:, 1:-1]).sum(1) / np.maximum(total, 1)
            rest = 1 - sums[:, -1]
            floor = np.where(freed > 0, freed, 1 / (total + 1))  # some mass is left even where nothing was discounted
            shrink = np.where(freed > 0, 1.0, total / (total + 1))
            weight = np.where(total > 0, floor / np.maximum(rest, 1e-300), 1.0)
            weight, total, shrink = (np.repeat(x, runs) for x in (weight, total, shrink))
            seen = shrink * known.d[np.minimum(count, DISCOUNTED + 1)] * count / np.maximum(total, 1)
            asked = g.gram >= 0
            gram = g.gram[asked]
            self.chance[asked] = np.where(count[gram] > 0, seen[gram], weight[gram] * self.chance[asked])
            self.size[asked] = count[gram]
            if answers[0]["d"] is not None:
                rank = [(unpack(r["d"], "u4").astype(np.uint64), r["bucket"]) for r in answers]
                numbers = np.concatenate([np.where(x > 0, (x - np.uint64(1)) * np.uint64(self.buckets) + np.uint64(b + 1), np.uint64(0)) for x, b in rank])
                self.number[asked] = numbers[gram]


def _gram_requests(known: DataFrame, buckets: int, hot_from: float, one: Unigrams, levels: list[Level]) -> DataFrame:
    """Each slice's grams of the level above ``levels``, by bucket, with training counts and chances on the level below."""
    shared = known.sparkSession.sparkContext.broadcast(levels)

    def run(rows: pa.Table) -> pa.Table:
        t = Tokens(rows, buckets, hot_from, one)
        t.climb(shared.value)
        p = t.grams()
        held = t.rows.column("held").to_numpy(zero_copy_only=False).astype(bool)
        train = ~np.repeat(held, np.diff(t.bounds)) & (p.gram >= 0)
        counts = np.bincount(p.gram[train], minlength=len(p.v))
        chunk, out = rows.column("chunk")[0].as_py(), []
        for b in range(buckets):
            x, y = int(p.cuts[b]), int(p.cuts[b + 1])
            if y > x:
                v, lengths, hot = p.histories(b)
                out.append((b, chunk, pack(v), pack(lengths.astype(np.uint32)), np.packbits(hot).tobytes(), pack(p.w[x:y]), pack(counts[x:y].astype(np.uint32)), pack(p.lower[x:y])))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        columns = zip(*out, strict=True) if out else [[]] * 8
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["bucket", "chunk", "v", "lengths", "hot", "w", "counts", "lower"])

    return known.groupBy("chunk").applyInArrow(run, "bucket int, chunk long, v binary, lengths binary, hot binary, w binary, counts binary, lower binary")


def _bucket_grams(rows: pa.Table, one: Unigrams | None):
    """All of a bucket's requests summed: histories, grams (history, word, count), and each request's places in both.

    ``one`` turns the words' counts of level 2 into chances; on the levels above chances are sent.
    """
    get = lambda c, kind: [unpack(x, kind) for x in rows.column(c).to_pylist()]
    vs, lengths, ws = get("v", "u8"), get("lengths", "u4"), get("w", "u8")
    hots = [np.unpackbits(np.frombuffer(h, np.uint8), count=len(v)).astype(bool) for h, v in zip(rows.column("hot").to_pylist(), vs, strict=True)]
    v, v_at = np.unique(np.concatenate(vs), return_inverse=True)
    w, w_at = np.unique(np.concatenate(ws), return_inverse=True)
    hot = np.zeros(len(v), bool)
    hot[v_at] = np.concatenate(hots)
    key, at = np.unique(np.repeat(v_at, np.concatenate(lengths)) * len(w) + w_at, return_inverse=True)
    lower = np.zeros(len(key))
    lower[at] = one(np.concatenate(get("lower", "i8"))) if one else np.concatenate(get("lower", "f8"))
    count = np.bincount(at, np.concatenate(get("counts", "u4")), len(key)).astype(np.int64)
    pv, pw = key // len(w), key % len(w)
    sums = [np.bincount(pv, count, len(v)), *(np.bincount(pv, count == r, len(v)) for r in range(1, DISCOUNTED + 1)), np.bincount(pv, np.where(count > 0, lower, 0.0), len(v))]
    return v, hot, w, pv, pw, count, np.stack(sums, 1), vs, v_at, ws, at


def _ranks(count: np.ndarray) -> np.ndarray:
    """Places from 1 by falling counts; 0 for what was not seen in training."""
    rank = np.zeros(len(count), np.uint32)
    rank[np.argsort(-count, kind="stable")] = np.arange(1, len(count) + 1, dtype=np.uint32)
    rank[count == 0] = 0
    return rank


def _gram_answers(requests: DataFrame, level: int, one: Unigrams, numbered: bool) -> DataFrame:
    """For each request the grams' counts, the histories' sums and, if ``numbered``, the grams' ranks in their bucket; the
    buckets' numbers of counts; parts of hot histories."""

    def run(rows: pa.Table) -> pa.Table:
        v, hot, _, _, _, count, sums, vs, v_at, ws, at = _bucket_grams(rows, one if level == 2 else None)
        out, i, j, bucket = [], 0, 0, rows.column("bucket")[0].as_py()
        rank = _ranks(count) if numbered else None
        for chunk, own_v, own_w in zip(rows.column("chunk").to_pylist(), vs, ws, strict=True):
            own, grams = sums[v_at[i : i + len(own_v)]], at[j : j + len(own_w)]
            out.append((chunk, level, bucket, pack(count[grams]), pack(own[:, :-1].astype(np.uint32).T.reshape(-1)), pack(own[:, -1]), pack(rank[grams]) if numbered else None))
            i, j = i + len(own_v), j + len(own_w)
        out.append((None, SUMS, bucket, np.bincount(np.minimum(count, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].astype(np.int64).tobytes(), None, None, None))
        for k in np.flatnonzero(hot).tolist():
            out.append((int(v[k]), HOT, bucket, sums[k].tobytes(), None, None, None))
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["chunk", "kind", "bucket", "a", "b", "c", "d"])

    return requests.groupBy("bucket").applyInArrow(run, f"{NEEDED}, d binary")


def _hot_sums(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hot histories, ascending, and their sums over all buckets; at most ``HOT_WORDS`` rows."""

    def run(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in rows.column("a").to_pylist()], 0)
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "a": pa.array([total.tobytes()], pa.binary())})

    found = sorted((r.chunk, bytes(r.a)) for r in answers.filter(F.col("kind") == HOT).select("chunk", "a").groupBy("chunk").applyInArrow(run, "chunk long, a binary").collect())
    return np.array([v for v, _ in found], np.int64), np.array([np.frombuffer(a, np.float64) for _, a in found]).reshape(len(found), DISCOUNTED + 2)


def _level(answers: DataFrame) -> Level:
    n = np.zeros(DISCOUNTED + 1, np.int64)
    for r in answers.filter(F.col("kind") == SUMS).select("a").toLocalIterator():
        n += np.frombuffer(r.a, np.int64)
    return Level(discounts([0, *n.tolist()]), _hot_sums(answers))


def _climbed(known: DataFrame, buckets: int, hot_from: float, one: Unigrams, order: int) -> tuple[DataFrame, list[Level], list[DataFrame]]:
    """The slices with the answers of all levels up to ``order``, the levels, and each level's requests."""
    known, levels, asked = known.withColumn("d", F.lit(None).cast("binary")), [], []
    for level in range(2, order + 1):
        requests = _gram_requests(known, buckets, hot_from, one, list(levels))
        answers = checkpointed(_gram_answers(requests, level, one, numbered=level < order))
        asked.append(requests)
        levels.append(_level(answers))
        known = known.unionByName(answers.filter(F.col("kind") == level))
    return known, levels, asked


def _scores(known: DataFrame, buckets: int, hot_from: float, one: Unigrams, levels: list[Level], id_kind: str) -> DataFrame:
    shared = known.sparkSession.sparkContext.broadcast(levels)

    def run(rows: pa.Table) -> pa.Table:
        p = Tokens(rows, buckets, hot_from, one)
        p.climb(shared.value)
        base = np.log10((p.count + 1) / (one.tokens + one.types + 1))
        known_n = np.diff(np.concatenate([[0], np.cumsum(p.count > 0)])[p.bounds])
        return p.rows.append_column("n_tokens", pa.array(np.diff(p.bounds))).append_column("n_known", pa.array(known_n)).append_column("base_score", pa.array(segment_sums(base, p.bounds))).append_column("score", pa.array(segment_sums(np.log10(p.chance), p.bounds)))

    return known.groupBy("chunk").applyInArrow(run, f"doc_id {id_kind}, held boolean, n_tokens long, n_known long, base_score double, score double")


def _prepared(docs: DataFrame, held_out, stored: bool):
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:  # else splits follow the number of executors
        spark.conf.set("spark.sql.files.minPartitionNum", max(1, spark.sparkContext.defaultParallelism))
    docs = (docs if stored else written(docs, "texts")).withColumn("split", F.spark_partition_id())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, math.ceil(size / BUCKET_BYTES))
    answers = checkpointed(_word_answers(_word_requests(docs, buckets), buckets))
    sums = np.zeros(DISCOUNTED + 3, np.int64)
    for r in answers.filter("kind = 9").select("a").toLocalIterator():
        sums += np.frombuffer(r.a, np.int64)
    one = Unigrams(int(sums[0]), int(sums[1]), [0, *sums[2:].tolist()])
    known = _texts(docs, buckets).unionByName(answers.filter("kind = 1"))
    hot_from = max(64.0, sums[0] / min(8 * buckets, HOT_WORDS))
    return docs, buckets, one, known, hot_from


def score_documents(docs: DataFrame, held_out, stored: bool = False, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, learnt from rows not held out.

    ``stored`` tells that ``docs`` is read from files as they are; other inputs are written to the shared folder first.
    ``order`` is the number of words of the longest grams, 1 to 7; each one above 1 is another round over the slices.
    """
    if not 1 <= order <= 7:
        raise ValueError("the order is a number from 1 to 7")
    docs, buckets, one, known, hot_from = _prepared(docs, held_out, stored)
    known, levels, _ = _climbed(known, buckets, hot_from, one, order)
    out = _scores(known, buckets, hot_from, one, levels, docs.schema["doc_id"].dataType.simpleString())
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(one.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def gram_table(docs: DataFrame, held_out, stored: bool = False, order: int = 2) -> DataFrame:
    """(bucket, history, word, number, count, level) of all grams of 2 to ``order`` words seen in training, stored by level.

    A history is the number of the gram of the level below (on level 2 a word's number; 2^62 is the start of a text).
    """
    _, buckets, one, known, hot_from = _prepared(docs, held_out, stored)
    *_, asked = _climbed(known, buckets, hot_from, one, order)

    def table_of(level: int):
        def run(rows: pa.Table) -> pa.Table:
            v, _, w, pv, pw, count, *_ = _bucket_grams(rows, one if level == 2 else None)
            seen, bucket = count > 0, rows.column("bucket")[0].as_py()
            number = (_ranks(count)[seen].astype(np.int64) - 1) * buckets + bucket + 1
            return pa.table({"bucket": pa.array(np.full(seen.sum(), bucket, np.int32)), "history": pa.array(v[pv[seen]].astype(np.int64)), "word": pa.array(w[pw[seen]].astype(np.int64)), "number": pa.array(number), "count": pa.array(count[seen]), "level": pa.array(np.full(seen.sum(), level, np.int32))})

        return run

    form = "bucket int, history long, word long, number long, count long, level int"
    out = docs.sparkSession.createDataFrame([], form)
    for level, requests in enumerate(asked, 2):
        out = out.unionByName(requests.groupBy("bucket").applyInArrow(table_of(level), form))
    path = new_folder(docs.sparkSession, "grams")
    out.write.partitionBy("level").parquet(path)
    return docs.sparkSession.read.schema(form).parquet(path)


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``; one row in seven is held out from training."""
    return score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), crc_bucket("doc_id", HELD_OUT_OF) == HELD_OUT, stored=True)
