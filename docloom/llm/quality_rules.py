"""Quality rules: counting rules on words, and a calibrated logistic regression on hashed n-grams.

The model sees the relative frequencies of hashed words, word pairs, byte 4-grams and pairs of word forms. It is fitted on a bounded
sample of labelled rows (``SAMPLE_ROWS``, those with the lowest hashes of their ids); one row in four of the
sample is kept back to calibrate probabilities. All rows are scored in Arrow batches.

Null and empty texts have no words and fail the rule on words; repeated rows are judged alike, each by itself;
an empty table gives an empty result; with no labels the model lets every row pass. Columns other than
``doc_id`` and ``text`` are not read by ``judge`` and pass through ``keep`` unchanged.

Windows and lines are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import ngrams as N
from docloom.llm import textkernel as K
from docloom.llm.tables import table

SAMPLE_ROWS = 2_400
MIN_WORDS, WINDOW, REPEAT_PERCENT, KEEP_FROM = 10, 5, 20, 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, bounds = K.word_spans(buf, offsets)
    text = K.text_of(bounds)
    chars = np.flatnonzero(~K.SPACE[buf] & ((buf & 0xC0) != 0x80))
    words = K.span_hashes(buf, starts, ends)
    win = K.windows(words, WINDOW)
    inside = text[: len(win)] == text[WINDOW - 1 :] if len(win) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    twice = at[_repeated(win[at], text[at], first=True)]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    line_starts = np.union1d(np.flatnonzero(buf == 10) + 1, offsets[:-1])
    line_starts = line_starts[line_starts < len(buf)]
    line_ends = np.append(line_starts[1:], len(buf))[: len(line_starts)].astype(np.int64)
    line_ends -= buf[line_ends - 1] == 10
    full = np.flatnonzero(np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends))
    line_starts, line_ends = line_starts[full], line_ends[full]
    lines = K.span_hashes(buf, line_starts, line_ends)
    line_bounds = np.searchsorted(line_starts, offsets)
    again = np.zeros(len(lines), bool)
    again[_repeated(lines, K.text_of(line_bounds), first=False)] = True
    return {
        "n_words": np.diff(bounds),
        "word_chars": np.diff(np.searchsorted(chars, offsets)),
        "n_symbols": np.diff(np.searchsorted(np.flatnonzero(SYMBOLS[buf]), offsets)),
        "n_dup_lines": K.sums_between(again, line_bounds),
        "n_repeat_words": K.sums_between(covered, bounds),
    }


def _repeated(hashes: np.ndarray, text: np.ndarray, first: bool) -> np.ndarray:
    """Places whose hash occurs again in the same text; without ``first``, only those after the first one."""
    keys = K.mix64(hashes + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    return np.unique(np.concatenate([order[1:][same], order[:-1][same]])) if first else order[1:][same]


class FrequencyModel:
    """Logistic regression on relative frequencies of n-grams, with a calibrated probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, intercept: float):
        self.weights, self.bias, self.slope, self.intercept = weights, bias, slope, intercept

    def probabilities(self, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        margin = self.bias + sum(N.segment_sums(self.weights[ids], bounds) / np.maximum(np.diff(bounds), 1) for ids, bounds in kinds)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.intercept, -30, 30)))


def fit(sample: N.Sample, steps: int = 60, rate: float = 2.0, decay: float = 1e-6, least_texts: int = 5) -> FrequencyModel:
    """Full-batch gradient steps, scaled for each feature by its past gradients."""
    weights, y = np.zeros(N.FEATURES), sample.y
    if len(set(y.tolist())) < 2:
        return FrequencyModel(weights, 0.0, 0.0, 0.0 if not len(y) or y[0] else -1.0)
    shares = np.empty(len(sample.ids), np.float32)
    for k in range(len(y)):
        at = slice(sample.bounds[k], sample.bounds[k + 1])
        kind = sample.ids[at] // N.SPACE
        shares[at] = sample.counts[at] / np.maximum(np.bincount(kind, sample.counts[at], N.KINDS), 1)[kind]
    sample = N.Sample(y, sample.ids, shares, sample.bounds).keep(np.bincount(sample.ids, minlength=N.FEATURES) >= least_texts)
    values = sample.counts
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    fitted = ~held
    share = np.where(y == 1, 0.5 / max(1, (y[fitted] == 1).sum()), 0.5 / max(1, (y[fitted] == 0).sum())) * fitted
    past, bias, bias_past = np.zeros(N.FEATURES), 0.0, 0.0
    for _ in range(steps):
        margin = bias + sample.sums(weights, values)
        pull = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * share
        grad = sample.spread(pull, values) + decay * weights
        past += grad * grad
        weights -= rate * grad / (np.sqrt(past) + 1e-9)
        bias_past += pull.sum() ** 2
        bias -= rate * pull.sum() / (np.sqrt(bias_past) + 1e-9)
    margin = bias + sample.sums(weights, values)
    judged = held if held.any() else fitted
    return FrequencyModel(weights, bias, *N.calibrate(margin[judged], y[judged]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FrequencyModel:
    return fit(N.labelled_sample(docs, labels, "quality", sample_rows))


def _judged(model: FrequencyModel, column: pa.Array, keep_from: float) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    for lo, hi, buf, offsets in K.text_slices(column):
        out = rule_counts(buf, offsets)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
        out["probability"] = model.probabilities(N.features(buf, offsets))
        out["kept"] = ~out["base_failed"] & (out["probability"] >= keep_from)
        yield lo, hi, out


def judge(docs: DataFrame, model: FrequencyModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept of every row."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, out in _judged(model.value, batch.column(1), keep_from):
                names = [*COUNTS, "base_failed", "probability", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(out[n]) for n in names)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, probability double, kept boolean")


def keep(docs: DataFrame, model: FrequencyModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows that the rules and the model accept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mask = np.concatenate([out["kept"] for _, _, out in _judged(model.value, batch.column(at), keep_from)])
                yield batch.filter(pa.array(mask))

    return docs.mapInArrow(accept, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and model on every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
