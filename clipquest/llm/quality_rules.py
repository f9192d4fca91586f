"""Quality rules: robust outliers of text statistics, by minimum covariance determinant."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquest.llm.rows import documents, raw_words
from clipquest.session import materialize


@dataclass(frozen=True)
class OutlierRules:
    """``keep`` of a group's rows make its estimate, after at most ``steps`` concentration steps.

    Steps end earlier, once no estimate's log determinant falls by more than ``settled``.
    A group (language and source) is judged as if ``prior`` more rows with the moments of
    its language's estimate belonged to it, and a language with those of the estimate of
    all rows: small groups lean on their language, large ones hardly, and no number of
    rows makes a jump. ``beyond`` is the share of normally distributed rows past the cut,
    a quantile of the chi-square distribution: 10^10 such rows lose none. ``floors`` are
    the smallest standard deviations that count, per statistic, so that constant ones say
    nothing. Quantiles (the starts' medians and spreads, and the distance that ``keep``
    of the rows do not exceed) are off by at most about one in ``ranks`` of a group's
    ranks, and exact in groups of fewer than half as many rows.
    """

    keep: float = 0.75
    steps: int = 20
    settled: float = 0.01
    prior: float = 200.0
    beyond: float = 1e-12
    ranks: int = 1000
    floors: tuple[float, ...] = (0.5, 0.1, 0.02, 0.15, 0.1, 0.03, 0.03, 0.05)

    @property
    def cut(self) -> float:
        """The squared distance beyond which a row is an outlier."""
        return chi_square_cut(self.beyond, STATISTICS)

    @property
    def consistency(self) -> float:
        """What the covariance of the nearest ``keep`` of normal rows falls short by."""
        return self.keep / (1 - chi_square_tail(chi_square_cut(1 - self.keep, STATISTICS), STATISTICS + 2))


def chi_square_tail(x: float, degrees: int) -> float:
    """The chance of a chi-square value beyond ``x``, for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def chi_square_cut(beyond: float, degrees: int) -> float:
    """The value that a chi-square one exceeds with chance ``beyond``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, degrees) > beyond else (low, middle)
    return high


_SYMBOLS = ("#", "*", "$", "%", "&", "|", "<", ">")
# Capitals, punctuation and digits.
_KINDS = np.zeros((3, 256), bool)
_KINDS[0, 65:91] = True
_KINDS[1, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_KINDS[2, 48:58] = True
STATISTICS = 8


def text_statistics(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """Counts of the contract, and the transformed vector.

    The vector: log of words; log of characters per word; square root of the share
    of symbols in characters; shares of repeated lines and of words in repeated
    windows; square roots of the shares of capitals, ASCII punctuation and digits
    in bytes.
    """
    words = raw_words(text)
    n, data = len(words), text.encode("utf-8", "surrogatepass")
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = sum(data.count(s.encode()) for s in _SYMBOLS)
    lines = [line for line in text.split("\n") if raw_words(line)]
    doubled = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    codes = np.frombuffer(data, np.uint8)
    shares = [_KINDS[i][codes].sum() / max(1, len(codes)) for i in range(3)]
    vector = [np.log1p(n), np.log1p(chars / max(1, n)), np.sqrt(symbols / max(1, chars)),
              doubled / max(1, len(lines)), repeated / max(1, n), *np.sqrt(shares)]
    return (n, chars, symbols, doubled, repeated), vector


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen, twice = set(), set()
    for window in windows:
        (twice if window in seen else seen).add(window)
    if not twice:
        return 0
    inside = bytearray(len(words))
    for i, window in enumerate(windows):
        if window in twice:
            inside[i:i + 3] = b"\1\1\1"
    return sum(inside)


def statistics(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, lang, source``, the counts and ``x``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, vectors = [], []
            for text in batch.column(4):
                one, vector = text_statistics(text.as_py())
                counts.append(one)
                vectors.append(vector)
            columns = zip(*counts) if counts else [[]] * 5
            yield pa.record_batch(
                [*batch.columns[:4], *(pa.array(list(c), pa.int64()) for c in columns),
                 pa.array(vectors, pa.list_(pa.float64()))],
                ["doc_id", "text_hash", "lang", "source", "n_words", "word_chars", "n_symbols",
                 "n_dup_lines", "n_repeat_words", "x"])

    rows = documents(docs, F.coalesce("lang", F.lit("")).alias("lang"),
                     F.coalesce("source", F.lit("")).alias("source"))
    return rows.select("doc_id", "text_hash", "lang", "source", "text").mapInArrow(
        read, "doc_id bigint, text_hash bigint, lang string, source string, n_words bigint, "
              "word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
              "x array<double>")


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Row count, sums and sums of products of ``x`` per group, added up map side."""
    d = STATISTICS
    x = [F.get("x", i) for i in range(d)]
    sums = [F.sum(v) for v in x]
    products = [F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("sums"),
                                   F.array(*products).alias("products"))


_ESTIMATE = "center array<double>, cover array<double>, inverse array<double>, logdet double"
_VECTOR = pa.list_(pa.float64())


def _square(products: list[float]) -> np.ndarray:
    full = np.zeros((STATISTICS, STATISTICS))
    full[np.triu_indices(STATISTICS)] = products
    return full + np.triu(full, 1).T


def _estimates(moments: DataFrame, solve: Callable, keys: tuple[str, ...]) -> DataFrame:
    """``keys``, ``before`` and what ``solve`` makes of each row of ``moments``: a centre and a covariance.

    With it come the inverse and the log determinant of the covariance plus the floors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(row) for row in batch.to_pylist()]
            yield pa.record_batch(
                [*(batch.column(k) for k in (*keys, "before")),
                 *(pa.array([f[i].ravel().tolist() for f in found], _VECTOR) for i in range(3)),
                 pa.array([f[3] for f in found], pa.float64())],
                [*keys, "before", "center", "cover", "inverse", "logdet"])

    kinds = {"start": "int"}
    names = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in keys)
    return moments.mapInArrow(run, f"{names}, before double, {_ESTIMATE}")


def _solved(center: np.ndarray, cover: np.ndarray, floor: np.ndarray) -> tuple:
    return center, cover, np.linalg.inv(cover + floor), float(np.linalg.slogdet(cover + floor)[1])


def _distance() -> tuple[Column, Column]:
    """Squared Mahalanobis distance of ``x`` to ``center`` under ``inverse``."""
    d = STATISTICS
    off = F.zip_with("x", "center", lambda a, b: a - b)
    row = lambda i: F.aggregate(
        F.zip_with(F.slice("inverse", i * d + 1, d), F.col("off"), lambda a, b: a * b),
        F.lit(0.0), lambda a, b: a + b)
    return off, sum((F.get("off", i) * row(i) for i in range(1, d)), F.get("off", 0) * row(0))


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    off, distance = _distance()
    return rows.join(estimates.drop("parent", "before", "cover", "logdet"), "group").withColumn(
        "off", off).withColumn("distance", distance).drop("off", "center", "inverse")


def _starts(rows: DataFrame, rules: OutlierRules) -> DataFrame:
    """Three estimates of each group: ``start, group, before, center, cover, inverse, logdet``.

    All have the medians for their centre and the middle halves' spreads for standard
    deviations. They differ in the correlations: none; those of the hyperbolic tangents
    of the standardised statistics; those of the standardised vectors' directions.
    """
    d, floors = STATISTICS, np.array(rules.floors)
    quantiles = materialize(rows.groupBy("group").agg(*(
        F.percentile_approx(F.get("x", i), [0.25, 0.5, 0.75], rules.ranks).alias(f"q{i}")
        for i in range(d))).select(
            "group", F.array(*(F.get(f"q{i}", 1) for i in range(d))).alias("center"),
            F.array(*(F.greatest((F.get(f"q{i}", 2) - F.get(f"q{i}", 0)) / 1.349, F.lit(rules.floors[i]))
                      for i in range(d))).alias("spread")), "quantiles")
    z = F.zip_with(F.zip_with("x", "center", lambda a, b: a - b), "spread", lambda a, b: a / b)
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v))
    standard = rows.join(quantiles, "group").withColumn("z", z).withColumn("length", length)
    kinds = F.array(
        F.struct(F.lit(0).alias("start"), F.array(*([F.lit(0.0)] * d)).alias("x")),
        F.struct(F.lit(1).alias("start"), F.transform("z", F.tanh).alias("x")),
        F.struct(F.lit(2).alias("start"), F.transform(
            "z", lambda v: v / F.greatest("length", F.lit(1e-12))).alias("x")))
    moments = _moments(standard.select("group", F.explode(kinds).alias("k")).select("group", "k.*"),
                       "start", "group")

    def solve(row: dict) -> tuple:
        second, spread = _square(row["products"]), np.array(row["spread"])
        scale = np.sqrt(np.maximum(np.diag(second), 1e-12))
        alike = second / np.outer(scale, scale)
        np.fill_diagonal(alike, 1.0)
        return _solved(np.array(row["center"]), alike * np.outer(spread, spread),
                       np.diag(np.square(floors)) * 1e-3)

    nothing_yet = F.lit(float("inf")).alias("before")
    return _estimates(moments.join(quantiles, "group").select("*", nothing_yet), solve, ("start", "group"))


def _concentrated(rows: DataFrame, priors: DataFrame | None, rules: OutlierRules) -> DataFrame:
    """The minimum covariance determinant of each ``group`` of ``rows`` (``group, parent, x``).

    A step takes the ``keep`` share of a group's rows nearest to an estimate and estimates
    anew, the parent's moments included as ``prior`` rows; that never raises the
    determinant. Of a group's starts, the one that ends with the lowest determinant stays.
    """
    floor = np.diag(np.square(rules.floors))
    keys = ("start", "group")

    def solve(row: dict) -> tuple:
        n, sums, second = row["n"], np.array(row["sums"]), _square(row["products"])
        if row["prior_center"] is not None:
            center = np.array(row["prior_center"])
            n = n + rules.prior
            sums = sums + rules.prior * center
            second = second + rules.prior * (
                np.array(row["prior_cover"]).reshape(floor.shape) + np.outer(center, center))
        center = sums / n
        return _solved(center, second / n - np.outer(center, center), floor)

    if priors is not None:
        priors = priors.select(F.col("group").alias("parent"), F.col("center").alias("prior_center"),
                               F.col("cover").alias("prior_cover"))
    found = materialize(_starts(rows, rules), "starts")
    for step in range(rules.steps):
        near = _with_distance(rows, found)
        limit = materialize(near.groupBy(*keys).agg(
            F.percentile_approx("distance", rules.keep, rules.ranks).alias("limit")), "limits")
        inside = near.join(limit, [*keys]).filter("distance <= limit")
        moments = _moments(inside, *keys, "parent")
        if priors is not None:
            moments = moments.join(priors, "parent", "left")
        else:
            none = F.lit(None).cast("array<double>")
            moments = moments.select("*", none.alias("prior_center"), none.alias("prior_cover"))
        before = F.col("logdet") if step else F.col("before")
        found = materialize(_estimates(
            moments.join(found.select(*keys, before.alias("before")), [*keys]), solve, keys), "estimates")
        if found.filter(F.col("before") - F.col("logdet") > rules.settled).isEmpty():
            break
    kept = ("center", "cover", "logdet")
    return found.groupBy("group").agg(
        F.min_by(F.struct(*kept), F.struct("logdet", "start")).alias("best")).select("group", "best.*")


def _final(estimates: DataFrame, rules: OutlierRules) -> DataFrame:
    """``group, center, inverse`` of the covariance made consistent for normal rows, and the floors."""
    floor, factor = np.diag(np.square(rules.floors)), rules.consistency

    def solve(row: dict) -> tuple:
        return _solved(np.array(row["center"]),
                       factor * np.array(row["cover"]).reshape(floor.shape), floor)

    return _estimates(estimates.withColumn("before", F.lit(0.0)), solve, ("group",)).select(
        "group", "center", "inverse")


def robust_outliers(rows: DataFrame, rules: OutlierRules) -> DataFrame:
    """``rows`` (``lang, source, x``) with ``group`` and ``distance`` to its group's robust estimate.

    Minimum covariance determinants are estimated for all rows, then per language, then per
    language and source, each leaning on the one before. Every step adds moments up map
    side, so a group may hold any share of all rows; quantiles are sketches of bounded
    size. The statistics are written once and read by all steps. Estimates are written
    too, so Spark broadcasts them only when their measured size is small, and otherwise
    meets them by a join whose hot groups it splits.
    """
    whole, lang, each = F.lit("{}"), F.to_json(F.struct("lang")), F.to_json(F.struct("lang", "source"))
    rows = materialize(rows.withColumn("group", each), "statistics")
    estimates = None
    for group, parent in ((whole, whole), (lang, whole), (each, lang)):
        level = rows.select(group.alias("group"), parent.alias("parent"), "x")
        estimates = materialize(_concentrated(level, estimates, rules), "concentrated")
    return _with_distance(rows, materialize(_final(estimates, rules), "final"))


def judge_documents(docs: DataFrame, rules: OutlierRules = OutlierRules()) -> DataFrame:
    """``doc_id, text_hash``, the counts, ``base_failed``, ``distance`` and ``kept`` of every row.

    A row is kept if it does not fail the base rule (fewer than 50 words, or over
    half of its words in repeated windows) and its vector is no outlier of its
    group. All rows make the estimates. Null texts have no words; a null language
    or source is an empty one. Null ids and repeated rows keep their rows; further
    columns are ignored; an empty table gives none. A group of equal vectors has
    the floors for its spread. A very long text is read whole by one task, in memory
    that grows with its length.
    """
    judged = robust_outliers(statistics(docs), rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", failed.alias("base_failed"), "distance",
                         (~failed & (F.col("distance") <= rules.cut)).alias("kept"))
