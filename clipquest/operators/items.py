"""Question items: validation, result columns and counters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

REQUIRED = ("id", "question", "question_type")


def item_key(items: DataFrame) -> tuple[str, ...]:
    """The columns that tell items apart and order them: ``pos`` restarts in each source."""
    return tuple(c for c in ("source", "offset", "pos") if c in items.columns)


def is_complete(*columns: str) -> Column:
    """All required fields present and non-empty; whitespace counts as text."""
    return reduce(and_, [F.coalesce(F.col(name), F.lit("")) != ""
                         for name in columns or REQUIRED])


def valid_items(items: DataFrame) -> DataFrame:
    """Items that can be asked; the filter reaches a Parquet scan."""
    return items.filter(reduce(and_, [F.col(name) != "" for name in REQUIRED]))


def rejected_items(items: DataFrame) -> DataFrame:
    """Items left out, each with the names of its missing fields."""
    missing = F.array_compact(F.array(*[
        F.when(~is_complete(name), F.lit(name)) for name in REQUIRED]))
    return items.filter(~is_complete()).withColumn("missing", F.array_join(missing, ","))


def with_answers(df: DataFrame, answer: Column, raw: Column, rationale: Column,
                 video_path: Column, keep_rationale: bool = True) -> DataFrame:
    """Add the result columns; NULL stands for a key that is left out."""
    kept = F.when(rationale != "", rationale) if keep_rationale else F.lit(None).cast("string")
    return df.withColumns({
        "model_answer": answer,
        "model_raw": raw,
        "model_rationale": kept,
        "video_path": video_path,
    })


def _counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("items"),
        F.count_if(~is_complete()).alias("skipped"),
        F.count_if(is_complete() & F.col("video_path").isNull()).alias("without_video"),
        F.count_if(is_complete() & (F.col("model_answer") == "")).alias("empty_answers"),
    ]


def item_counters(results: DataFrame) -> DataFrame:
    """One row: items seen, skipped, without a video, and with an empty answer."""
    return results.agg(*_counters())


def observe_items(results: DataFrame, observation: Observation) -> DataFrame:
    """Collect the same counters while ``results`` is being written."""
    return results.observe(observation, *_counters())
