"""Hashed word and character n-grams of texts, and the bounded labelled sample that models are fitted on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textkernel as K

BITS = 17
SPACE = 1 << BITS
#: All texts of a sample together have at most so many bytes.
SAMPLE_BYTES = 16 << 20
#: Kinds of features, each with its own SPACE of ids: words, word pairs, four neighbouring bytes, pairs of word forms.
KINDS = 4
FEATURES = KINDS * SPACE
CAPITAL, SIGN = np.zeros(256, bool), np.zeros(256, bool)
CAPITAL[65:91] = True
SIGN[list(b"!#$%&*|<>=")] = True


def forms(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Form of each word: capital first, capitals only, a sign in it, the same as the word before."""
    capitals = np.concatenate([[0], np.cumsum(CAPITAL[buf])])
    signs = np.concatenate([[0], np.cumsum(SIGN[buf])])
    upper = capitals[ends] - capitals[starts]
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    same[bounds[:-1][bounds[:-1] < len(words)]] = 0
    return (CAPITAL[buf[starts]] if len(starts) else same) + 2 * (upper >= np.maximum(2, (ends - starts) // 2)) + 4 * (signs[ends] > signs[starts]) + 8 * same


def features(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: feature ids of all texts one after another, and the bounds of the texts in them."""
    starts, ends, bounds = K.word_spans(buf, offsets)
    words = K.span_hashes(buf, starts, ends)
    single = (words >> np.uint64(64 - BITS)).astype(np.int64)
    counts = np.diff(bounds)
    pairs = (K.windows(words, 2) >> np.uint64(64 - BITS)).astype(np.int64) + SPACE
    inner = np.ones(len(pairs), bool)
    cut = bounds[1:-1] - 1
    inner[cut[(cut >= 0) & (cut < len(pairs))]] = False
    pair_bounds = np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))])
    n = max(0, len(buf) - 3)
    four = buf[:n].astype(np.uint32)
    for k in range(1, 4):
        four |= buf[k : n + k].astype(np.uint32) << np.uint32(8 * k)
    chars = ((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + 2 * SPACE
    whole = np.ones(n, bool)
    for k in range(1, 4):
        at = offsets[1:-1] - k
        whole[at[(at >= 0) & (at < n)]] = False
    char_bounds = np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - 3, 0))])
    form = forms(buf, starts, ends, words, bounds)
    shapes = form.copy()
    shapes[1:] += 16 * form[:-1]
    first = bounds[:-1][bounds[:-1] < len(words)]
    shapes[first] = form[first] + 256
    return [(single, bounds), (pairs[inner], pair_bounds), (chars[whole], char_bounds), (shapes.astype(np.int64) + 3 * SPACE, bounds)]


def distinct(kinds: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text, ascending: ids, occurrences, bounds of the texts."""
    texts = len(kinds[0][1]) - 1
    keys = np.concatenate([ids + K.text_of(bounds) * FEATURES for ids, bounds in kinds])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    bounds = np.searchsorted(keys, np.arange(texts + 1) * FEATURES)
    return keys % FEATURES, counts, bounds


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums by text that don't depend on the other texts of the batch."""
    out = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, bounds[:-1][some])
    return out


@dataclass
class Sample:
    """Labelled texts one after another: labels, and each text's distinct features with their occurrences."""

    y: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Sample:
        """Of (label, features, occurrences) rows, which are taken out of the list one by one."""
        y = np.array([min(1, max(0, label)) for label, _, _ in rows], np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(ids) for _, ids, _ in rows])]).astype(np.int64)
        ids, counts = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.float32)
        for k in range(len(rows) - 1, -1, -1):
            _, i, c = rows.pop()
            ids[bounds[k] : bounds[k + 1]], counts[bounds[k] : bounds[k + 1]] = i, c
        return cls(y, ids, counts, bounds)

    def parts(self, texts: int = 128) -> Iterator[tuple[int, int, slice]]:
        """(first text, end text, items) of a few texts at a time."""
        for lo in range(0, len(self.y), texts):
            hi = min(lo + texts, len(self.y))
            yield lo, hi, slice(self.bounds[lo], self.bounds[hi])

    def sums(self, weights: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each text the sum of weight times value over its features."""
        out = np.empty(len(self.y))
        for lo, hi, at in self.parts():
            out[lo:hi] = segment_sums(weights[self.ids[at]] * values[at], self.bounds[lo : hi + 1] - self.bounds[lo])
        return out

    def spread(self, of_texts: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each feature the sum of its values, each times its text's number."""
        out = np.zeros(FEATURES)
        for lo, hi, at in self.parts():
            out += np.bincount(self.ids[at], np.repeat(of_texts[lo:hi], np.diff(self.bounds[lo : hi + 1])) * values[at], FEATURES)
        return out

    def keep(self, wanted: np.ndarray) -> Sample:
        """Only the features that are wanted."""
        kept = wanted[self.ids]
        sizes = [np.count_nonzero(kept[a:b]) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]
        return Sample(self.y, self.ids[kept], self.counts[kept], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, limit_bytes: int = SAMPLE_BYTES) -> Sample:
    """Features of the labelled texts with the ``limit`` lowest hashes of their ids, as far as their bytes stay below
    ``limit_bytes`` (a text that would pass it is left out). A document with several labels has the lowest."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, taken = limit_bytes, []
    for i, n in sizes:
        if n <= left:
            taken.append(i)
            left -= n
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = docs.sparkSession.createDataFrame([(i,) for i in taken], f"doc_id {kind}")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in K.text_slices(batch.column(2)):
                ids, counts, bounds = distinct(features(buf, offsets))
                cut = lambda a, kind: pa.array([a[x:y].astype(kind).tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), cut(ids, "<u4"), cut(counts, "<u4")], ["doc_id", "y", "ids", "counts"])

    got = rows.join(F.broadcast(few), "doc_id", "left_semi").mapInArrow(extract, f"doc_id {kind}, y int, ids binary, counts binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.ids)))
    parts = [(r.y, np.frombuffer(r.ids, "<u4"), np.frombuffer(r.counts, "<u4")) for r in got]
    del got
    return Sample.of(parts)


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability of label 1 by a margin, with targets drawn in from 0 and 1."""
    plus, minus = (y == 1).sum(), (y == 0).sum()
    if not plus or not minus:
        return 0.0, float(np.log((plus + 1) / (minus + 1)))
    scale = max(1e-9, float(np.abs(margins).mean()))
    m, target = margins / scale, np.where(y == 1, (plus + 1) / (plus + 2), 1 / (minus + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * m).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a / scale), float(b)
