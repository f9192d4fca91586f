"""Lookup joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY, _SLICES, _SLICE, ROWS = "_hot_key", "_hot_slices", "_slice", "_rows"
_BUCKETS = 1 << 16


@dataclass(frozen=True)
class SkewPolicy:
    """Keys with more than ``rows_per_slice`` rows are split over several slices.

    Where there could be over ``max_hot_keys`` such keys, the limit is raised to
    that share of all rows; every key above it is split, so none is left out and
    the list of them, pairs of numbers, has a bounded size. No slice holds more
    rows than the limit, but for the chance of the hash that deals them.
    """

    rows_per_slice: int = 1_000_000
    max_hot_keys: int = 100_000


def rows_per_key(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Row counts per key, combined map side."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias(ROWS))


def large_keys(counts: DataFrame, on: Sequence[str], policy: SkewPolicy = SkewPolicy(),
               growth: int = 1) -> dict[int, int]:
    """Hashes and row counts of the largest keys; runs a job over ``counts``.

    Only keys that exceed a slice after growing ``growth``-fold are returned;
    there cannot be more of them than the policy allows.
    """
    total = counts.agg(F.sum(ROWS)).first()[0] or 0
    limit = max(policy.rows_per_slice // growth, -(-total // policy.max_hot_keys))
    over = counts.filter(F.col(ROWS) > limit)
    found: dict[int, int] = {}
    for key, rows in over.select(F.xxhash64(*on), ROWS).collect():
        found[key] = found.get(key, 0) + rows
    return found


def hot_keys(df: DataFrame, on: Sequence[str], policy: SkewPolicy = SkewPolicy()) -> dict[int, int]:
    """:func:`large_keys` of rows that are not counted yet.

    No key has more rows than all keys of its hash bucket, so keys are counted, and shuffled for
    that, only if one of the buckets is as large as a hot key.
    """
    bucket = F.pmod(F.xxhash64(*on), F.lit(_BUCKETS)).alias(_KEY)
    total, largest = df.groupBy(bucket).agg(F.count(F.lit(1)).alias(ROWS)).agg(F.sum(ROWS), F.max(ROWS)).first()
    if max(policy.rows_per_slice, -(-(total or 0) // policy.max_hot_keys)) >= (largest or 0):
        return {}
    return large_keys(rows_per_key(df, on), on, policy)


def only_keys(df: DataFrame, on: Sequence[str], keys: dict[int, int]) -> DataFrame:
    """Rows whose key has one of these hashes; a chance match keeps a row too many."""
    wanted = df.sparkSession.createDataFrame([(k,) for k in keys], f"{_KEY} bigint")
    return df.withColumn(_KEY, F.xxhash64(*on)).join(
        F.broadcast(wanted), _KEY, "left_semi").drop(_KEY)


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], *, spread: Sequence[str],
                how: str = "left", large: dict[int, int] | None = None,
                policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Join ``left`` to a table that has at most one row per key.

    A hot key of ``left`` is cut into slices by a hash of the ``spread``
    columns, and only its row of ``right`` is repeated, once per slice, so the
    result is that of the plain join. ``large`` comes from :func:`large_keys`;
    without it the keys of ``left`` are counted first. A chance hash match only
    splits a key that needed no splitting.
    """
    on = list(on)
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"lookup_join cannot do {how!r}")
    if large is None:
        large = hot_keys(left, on, policy)
    slices = [(key, -(-rows // policy.rows_per_slice)) for key, rows in large.items()
              if rows > policy.rows_per_slice]
    if not slices:
        return left.join(right, on, how)

    hot = F.broadcast(left.sparkSession.createDataFrame(slices, f"{_KEY} bigint, {_SLICES} int"))

    def with_slices(df: DataFrame) -> DataFrame:
        return df.withColumn(_KEY, F.xxhash64(*on)).join(hot, _KEY, "left").drop(_KEY)

    width = F.coalesce(F.col(_SLICES), F.lit(1))
    cut_left = with_slices(left).withColumn(
        _SLICE, F.pmod(F.xxhash64(*spread), width).cast("int"))
    cut_right = with_slices(right).withColumn(
        _SLICE, F.explode(F.sequence(F.lit(0), width - 1)))
    return (cut_left.drop(_SLICES).join(cut_right.drop(_SLICES), [*on, _SLICE], how)
            .drop(_SLICE))
