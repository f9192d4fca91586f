"""Quality of texts: support vectors on n-gram indicators scaled by class log-count ratios."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.llm.features import Rows, byte_grams, fitted, labelled_sample, repeated_pairs
from clipquest.llm.rows import documents, fold, free_names, text_slices


@dataclass(frozen=True)
class QualityModel:
    """Byte ``gram``-grams in ``1 << bits`` places; at most ``sample`` labelled rows to learn from.

    Further indicators say that a word follows itself in over these ``repeats`` shares of places.
    """

    gram: int = 4
    bits: int = 18
    sample: int = 20_000
    repeats: tuple[float, ...] = (0.0, 0.01, 0.03, 0.1, 0.3)
    cost: float = 1.0
    rounds: int = 12
    folds: int = 5
    threshold: float = 0.3

    @property
    def places(self) -> int:
        return (1 << self.bits) + len(self.repeats)


def log_count_ratio(rows: Rows, positive: np.ndarray, size: int) -> np.ndarray:
    """How much more of the positive than of the negative rows' features each one is, smoothed."""
    counts = np.ones((2, size))
    for features, one in zip(rows, positive):
        counts[int(one), features] += 1
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: Rows, signs: np.ndarray, ratio: np.ndarray, config: QualityModel
                            ) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model on scaled indicators of length one.

    Each step sets one row's dual variable to its best value between 0 and its
    cost; rows of the rarer class cost as much in total as those of the other.
    """
    weights, bias = np.zeros(len(ratio)), 0.0
    lengths = np.array([max(np.linalg.norm(ratio[f]), 1e-12) for f in rows])
    norms = np.array([(np.linalg.norm(ratio[f]) / n) ** 2 + 1.0 for f, n in zip(rows, lengths)])
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    cost = config.cost * 0.5 / share
    dual, random = np.zeros(len(rows)), np.random.default_rng(5)
    for _ in range(config.rounds):
        for i in random.permutation(len(rows)):
            # Scaled values are worked out again each time; only features are kept.
            features, sign = rows[i], signs[i]
            values = ratio[features] / lengths[i]
            gradient = sign * (weights[features] @ values + bias) - 1
            new = min(max(dual[i] - gradient / norms[i], 0.0), cost[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign
                weights[features] += step * values
                bias += step
                dual[i] = new
    return weights, bias


def _logistic(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method."""
    x = np.stack([margins, np.ones(len(margins))], 1)
    # Platt's targets keep the slope finite where margins separate the classes.
    ones = positive.sum()
    target = np.where(positive, (ones + 1) / (ones + 2), 1 / (len(positive) - ones + 2))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _margins(rows: Rows, weights: np.ndarray, ratio: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(rows))
    for i, features in enumerate(rows):
        scale = np.linalg.norm(ratio[features])
        out[i] = weights[features] @ ratio[features] / max(scale, 1e-12) + bias
    return out


def fit_quality(rows: Rows, labels: np.ndarray, config: QualityModel) -> bytes:
    """Four of five rows fit the model; the fifth turns its margins into probabilities."""
    positive, size = labels > 0, config.places
    test = np.arange(len(rows)) % 5 == 4
    if len(set(positive[~test])) < 2 or len(set(positive[test])) < 2:
        share = (positive.sum() + 1) / (len(rows) + 2)
        return _pack(weights=np.zeros(size, "f4"), ratio=np.zeros(size, "f4"),
                     rest=np.array([0.0, 0.0, np.log(share / (1 - share))]))
    own = [r for r, t in zip(rows, test) if not t]
    ratio = log_count_ratio(own, positive[~test], size)
    weights, bias = dual_coordinate_descent(own, np.where(positive[~test], 1.0, -1.0), ratio, config)
    margins = _margins([r for r, t in zip(rows, test) if t], weights, ratio, bias)
    return _pack(weights=weights.astype("f4"), ratio=ratio.astype("f4"),
                 rest=np.array([bias, *_logistic(margins, positive[test])]))


def quality_scores(docs: DataFrame, labels: DataFrame, config: QualityModel = QualityModel()
                   ) -> DataFrame:
    """``doc_id, text_hash, held_out, score, predicted`` of every row.

    Learns ``labels.quality`` from labelled rows whose CRC-32 of the id is not 0
    modulo ``folds``, at most ``sample`` of them. ``score`` is the probability of
    label 1. Only the text is an input. Scoring is one pass without a shuffle.

    Null and empty texts have no features and get the bias's score. With labels of
    one class, or none, every score is the smoothed share of label 1. A null
    ``doc_id`` counts as an empty text's CRC-32, 0. Repeated rows each get a row;
    further columns are ignored; an empty table gives none.
    """

    def features(data: np.ndarray, offsets: np.ndarray) -> Rows:
        return [np.concatenate(both) for both in zip(
            byte_grams(data, offsets, config.gram, config.bits),
            repeated_pairs(data, offsets, config.repeats, 1 << config.bits))]

    def fit(rows: Rows, known: np.ndarray) -> bytes:
        return fit_quality(rows, known, config)

    sample = labelled_sample(docs, labels, F.col("quality"), fold("doc_id", config.folds) != 0,
                             config.sample)
    model = docs.sparkSession.sparkContext.broadcast(
        fitted(sample, features, fit, fit_quality([], np.zeros(0), config)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = np.load(io.BytesIO(model.value))
        weights, ratio, (bias, slope, offset) = arrays["weights"], arrays["ratio"], arrays["rest"]
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                margins = _margins(features(data, offsets), weights, ratio, bias)
                chance = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
                yield pa.record_batch([part.column(0), part.column(2), pa.array(chance, pa.float64())],
                                      ["doc_id", "text_hash", "score"])

    scored = documents(docs).mapInArrow(score, "doc_id bigint, text_hash bigint, score double")
    return scored.select("doc_id", "text_hash", (fold("doc_id", config.folds) == 0).alias("held_out"),
                         "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, config: QualityModel = QualityModel()) -> DataFrame:
    """The rows of ``docs``, with their columns, that the classifier does not reject.

    See :func:`quality_scores`. Repeated rows go or stay together, columns of any name
    stay as they are, and an empty table gives no row.
    """
    own = free_names(docs, "doc", "text")
    key, text = F.coalesce("doc_id", F.lit(-(1 << 63))), F.coalesce("text", F.lit(""))
    rejected = quality_scores(docs, labels, config).filter("predicted = 0").select(key, "text_hash").toDF(
        *own).distinct()
    marked = docs.withColumns(dict(zip(own, (key, F.xxhash64(text)))))
    return marked.join(rejected.hint("shuffle_hash"), own, "left_anti").drop(*own)
