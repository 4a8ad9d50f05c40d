"""Quality classifier: naive Bayes features in a linear support vector machine.

Indicators of hashed words, word pairs, byte 4-grams and pairs of word forms are scaled by the log ratio of their smoothed counts in
the two classes; each row has length 1. A linear hinge-loss model is fitted to them by dual coordinate descent,
and a margin becomes a probability by a logistic curve fitted on rows kept back. Labels come from a bounded
sample (``SAMPLE_ROWS``) of rows that are not held out.

Null and empty texts have no features and get the score of a zero margin; with labels of one class or none all
rows get one score; repeated rows score alike; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ngrams as N
from docloom.llm import textkernel as K
from docloom.llm.tables import crc_bucket, table

SAMPLE_ROWS = 2_400
HELD_OUT_OF, HELD_OUT, POSITIVE_FROM = 4, 2, 0.7


class RatioModel:
    """Weights on scaled indicators: a text's margin is the sum of ``scaled`` over its features by its length."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, intercept: float):
        self.square, self.scaled, self.bias, self.slope, self.intercept = ratio**2, ratio * weights, bias, slope, intercept

    def margins(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        length = np.sqrt(N.segment_sums(self.square[ids], bounds))
        return self.bias + N.segment_sums(self.scaled[ids], bounds) / np.where(length > 0, length, 1)

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(ids, bounds) + self.intercept, -30, 30)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, limits: np.ndarray, rounds: int = 12, features: int = N.FEATURES) -> tuple[np.ndarray, float, np.ndarray]:
    """Hinge-loss weights and bias, and the dual variables: one at a time, each between 0 and its limit."""
    weights, bias = np.zeros(features), 0.0
    dual = np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            slack = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(limits[i], max(0.0, dual[i] - slack / norms[i]))
            if new != dual[i]:
                step = (new - dual[i]) * signs[i]
                weights[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
    return weights, bias, dual


def fit(sample: N.Sample, smoothing: float = 1.0, cost: float = 1.0, least_texts: int = 3, blend: float = 0.8) -> RatioModel:
    y = sample.y
    nothing = np.zeros(N.FEATURES)
    if len(set(y.tolist())) < 2:
        return RatioModel(nothing, nothing, 0.0, 0.0, *[float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))])
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    ones = np.ones(len(sample.ids), np.float32)
    plus, minus = sample.spread(1.0 * (~held & (y == 1)), ones), sample.spread(1.0 * (~held & (y == 0)), ones)
    p, q = plus + smoothing, minus + smoothing
    ratio = np.where(plus + minus >= least_texts, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)
    used = sample.keep(ratio != 0)
    rows, values = [], []
    for k in range(len(y)):
        rows.append(used.ids[used.bounds[k] : used.bounds[k + 1]])
        v = ratio[rows[-1]].astype(np.float32)
        values.append(v / np.float32(max(np.sqrt(v @ v), 1e-12)))
    fitted = np.flatnonzero(~held)
    n = np.bincount(y[fitted], minlength=2)
    limits = cost * len(fitted) / (2 * n[y[fitted]])
    weights, bias, _ = descend([rows[i] for i in fitted], [values[i] for i in fitted], np.where(y[fitted] == 1, 1.0, -1.0), limits)
    some = ratio != 0
    if some.any():  # drawn towards the mean size, at which the class ratios alone decide
        weights = np.where(some, (1 - blend) * np.abs(weights[some]).mean() + blend * weights, 0.0)
    model = RatioModel(ratio, weights, bias, 1.0, 0.0)
    judged = held if held.any() else ~held
    model.slope, model.intercept = N.calibrate(model.margins(sample.ids, sample.bounds)[judged], y[judged])
    return model


def score(docs: DataFrame, model: RatioModel) -> DataFrame:
    """doc_id and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in K.text_slices(batch.column(1)):
                ids, _, bounds = N.distinct(N.features(buf, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.value.scores(ids, bounds))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text; labels only from rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = crc_bucket("doc_id", HELD_OUT_OF) == HELD_OUT
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(~held_out)
    model = fit(N.labelled_sample(docs, labels, "quality", SAMPLE_ROWS))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= POSITIVE_FROM).cast("int").alias("predicted"))
