"""Toxicity as ordered grades: cumulative-link regression on hashed words."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.llm.features import Rows, fitted, labelled_sample, word_grams
from clipquest.llm.rows import documents, fold, text_slices


@dataclass(frozen=True)
class SeverityModel:
    """Distinct words in ``1 << bits`` places; at most ``sample`` labelled rows to learn from.

    Of the places, the ``terms`` whose presence in at least ``least`` toxic rows
    goes most surely with the label have a weight. ``grades`` ordered grades, 0 is clean. A text is called toxic at a
    probability of ``threshold`` or more for a grade above 0.
    """

    grades: int = 3
    bits: int = 18
    words: int = 1
    sample: int = 20_000
    terms: int = 2048
    least: int = 3
    markers: int = 64
    rounds: int = 150
    ridge: float = 1e-4
    folds: int = 5
    threshold: float = 0.3


def telling_terms(rows: Rows, toxic: np.ndarray, config: SeverityModel, count: int) -> np.ndarray:
    """Places ordered by the log odds of the label, in standard errors."""
    size = 1 << config.bits
    counts = np.zeros((2, size))
    for features, one in zip(rows, toxic):
        counts[int(one > 0), features] += 1
    totals = np.array([(toxic <= 0).sum(), (toxic > 0).sum()])[:, None] + 1.0
    odds = np.log((counts + 0.5) / (totals - counts + 0.5))
    sure = (odds[1] - odds[0]) / np.sqrt((1 / (counts + 0.5)).sum(0))
    sure[counts[1] < config.least] = -np.inf
    best = np.argsort(-sure, kind="stable")[:count]
    return best[sure[best] > 0]


def graded(rows: Rows, toxic: np.ndarray, config: SeverityModel) -> np.ndarray:
    """Grades of 0/1 labels: toxic rows rank by how many of the ``markers`` most telling terms they hold.

    Toxic rows with as few of them as the lowest share of toxic rows get grade 1,
    and so on up to the last grade.
    """
    marked = np.zeros(1 << config.bits, bool)
    marked[telling_terms(rows, toxic, config, config.markers)] = True
    held = np.array([marked[f].sum() for f in rows])
    out = np.zeros(len(rows), int)
    own = toxic > 0
    if own.any():
        edges = np.quantile(held[own], np.arange(1, config.grades - 1) / (config.grades - 1))
        out[own] = 1 + np.searchsorted(edges, held[own], "left")
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_ordinal(rows: Rows, grades: np.ndarray, count: int, config: SeverityModel
                ) -> tuple[np.ndarray, np.ndarray]:
    """Weights, shared by all grades, and rising thresholds: P(grade <= j) = s(threshold j - w x).

    Full-batch Adam on the penalised negative log-likelihood. The first threshold
    is free and the next ones add the exponential of a parameter, so they keep
    their order.
    """
    size, n = 1 << config.bits, len(rows)
    kept = np.zeros(size, bool)
    kept[telling_terms(rows, grades, config, config.terms)] = True
    rows = [r[kept[r]] for r in rows]
    flat = np.concatenate(rows) if n else np.zeros(0, int)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    share = np.cumsum(np.bincount(grades, minlength=count) + 1.0)[:-1] / (n + count)
    start = np.log(share / (1 - share))
    raw = np.concatenate([start[:1], np.log(np.maximum(1e-2, np.diff(start)))])
    weights = np.zeros(size)
    state = [np.zeros(size + len(raw)) for _ in range(2)]
    for step in range(1, config.rounds + 1):
        edges = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        score = np.bincount(owner, weights[flat], n)
        bounds = np.concatenate([[-np.inf], edges, [np.inf]])
        high, low = bounds[grades + 1] - score, bounds[grades] - score
        p_high = np.where(np.isinf(high), 1.0, _sigmoid(np.nan_to_num(high, posinf=0)))
        p_low = np.where(np.isinf(low), 0.0, _sigmoid(np.nan_to_num(low, neginf=0)))
        chance = np.maximum(p_high - p_low, 1e-12)
        up, down = p_high * (1 - p_high) / chance, p_low * (1 - p_low) / chance
        by_score = (up - down) / n
        by_weight = np.bincount(flat, by_score[owner], size) + config.ridge * weights
        by_edge = np.bincount(grades, -up / n, count)[:-1] + np.bincount(grades, down / n, count)[1:]
        tail = np.cumsum(by_edge[::-1])[::-1]
        by_raw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
        gradient = np.concatenate([by_weight, by_raw])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient ** 2
        move = 0.15 * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.99 ** step)) + 1e-8)
        weights, raw = weights - move[:size], raw - move[size:]
    return weights, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def grade_chances(scores: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each row's probability of each grade."""
    below = _sigmoid(edges[None, :] - scores[:, None])
    return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], 1))


def severity(docs: DataFrame, labels: DataFrame, config: SeverityModel = SeverityModel(),
             label: str = "toxic") -> DataFrame:
    """``doc_id, text_hash, held_out, expected_severity, grade, score, predicted`` of every row.

    Learns from labelled rows whose CRC-32 of the id is not 0 modulo ``folds``, at
    most ``sample`` of them. A ``label`` column with values over 1 holds the grades
    themselves (larger ones count as the last); 0/1 labels are graded by
    :func:`graded`. ``expected_severity`` is the mean grade under the model,
    ``grade`` the likeliest, ``score`` the probability of any grade above 0, and
    ``predicted`` 1 if that is ``threshold`` or more. Scoring needs no shuffle.

    Null and empty texts have no features and score as the thresholds say. Without
    two different grades to learn from, thresholds are the smoothed shares. A null
    ``doc_id`` counts as an empty text's CRC-32, 0. Repeated rows each get a row;
    further columns are ignored; an empty table gives none.
    """

    def features(data: np.ndarray, offsets: np.ndarray) -> Rows:
        return word_grams(data, offsets, config.words, config.bits)

    def fit(rows: Rows, known: np.ndarray) -> bytes:
        grades = np.clip(known, 0, config.grades - 1) if known.max(initial=0) > 1 else graded(
            rows, known, config)
        weights, edges = fit_ordinal(rows, grades, config.grades, config)
        out = io.BytesIO()
        np.savez_compressed(out, weights=weights.astype("f4"), edges=edges)
        return out.getvalue()

    sample = labelled_sample(docs, labels, F.col(label), fold("doc_id", config.folds) != 0, config.sample)
    model = docs.sparkSession.sparkContext.broadcast(
        fitted(sample, features, fit, fit([], np.zeros(0, int))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = np.load(io.BytesIO(model.value))
        weights, edges = arrays["weights"], arrays["edges"]
        grades = np.arange(len(edges) + 1)
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                scores = np.array([weights[f].sum() for f in features(data, offsets)])
                chances = grade_chances(scores, edges)
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array(chances @ grades, pa.float64()),
                     pa.array(chances.argmax(1), pa.int32()), pa.array(1 - chances[:, 0], pa.float64())],
                    ["doc_id", "text_hash", "expected_severity", "grade", "score"])

    scored = documents(docs).mapInArrow(
        score, "doc_id bigint, text_hash bigint, expected_severity double, grade int, score double")
    return scored.select("doc_id", "text_hash", (fold("doc_id", config.folds) == 0).alias("held_out"),
                         "expected_severity", "grade", "score",
                         (F.col("score") >= config.threshold).cast("int").alias("predicted"))
