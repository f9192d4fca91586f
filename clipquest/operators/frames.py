"""Frame plans per distinct (video, hints) pair and the frames they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquest.config import EvalConfig
from clipquest.functions import frame_files, frame_times
from clipquest.functions.timecode import hint_seconds
from clipquest.operators.frame_index import bit_set, frame_words, readable_prefix, word_number
from clipquest.operators.skew import (ROWS, SkewPolicy, large_keys, lookup_join, only_keys,
                                      rows_per_key)

KEY = ["id", "hints"]
FRAMES_TYPE = "array<struct<t: double, idx: bigint, path: string>>"

# Tiers: where the frames of a plan come from.
NO_FRAMES, SEEK, SCAN, FIRST_FRAME = 0, 1, 2, 3


def with_hints(items: DataFrame, config: EvalConfig) -> DataFrame:
    """Add the sorted hint seconds of every question."""
    return items.withColumn("hints", hint_seconds(F.col("question"), config.two_field))


def plan_keys(hinted: DataFrame) -> DataFrame:
    """Each distinct (id, hints) once, with the number of questions that share it."""
    return hinted.groupBy(*KEY).agg(F.count(F.lit(1)).alias(ROWS))


def video_facts(assets: DataFrame, videos: DataFrame, frame_index: DataFrame | None = None,
                first_frame: DataFrame | None = None,
                words: DataFrame | None = None) -> DataFrame:
    """Everything known per video id, one row each.

    All inputs are keyed by id, so the joins share one partitioning. A file
    without a row in ``videos`` cannot be opened; of several rows of an id the one
    with the most frames counts.
    """
    if words is None:
        words = frame_words(frame_index)
    known = videos.groupBy("id").agg(F.max(F.struct("total_frames", "fps")).alias("video"))
    facts = (assets
             .join(known.select("id", "video.fps", "video.total_frames", F.lit(True).alias("openable")),
                   "id", "left")
             .join(readable_prefix(words), "id", "left"))
    if first_frame is not None:
        grabbed = first_frame.select("id").distinct().withColumn("first_frame", F.lit(True))
        facts = facts.join(grabbed, "id", "left")
    else:
        facts = facts.withColumn("first_frame", F.lit(None).cast("boolean"))
    return facts.select(
        "id", "video_path", "fps", F.coalesce("total_frames", F.lit(0)).alias("total_frames"),
        F.coalesce("openable", F.lit(False)).alias("openable"),
        F.coalesce("readable", F.lit(0)).alias("readable"),
        F.coalesce("first_frame", F.lit(False)).alias("first_frame"))


def with_frame_times(keys: DataFrame, config: EvalConfig) -> DataFrame:
    """Add ``times``, the bounded plan, to rows with hints, fps and total_frames."""
    end = F.col("_end")
    wanted = F.when(
        F.size("hints") > 0, frame_times.hinted_times(F.col("hints"), config.radius, end)
    ).otherwise(frame_times.even_times(config.frames_per_question, end))
    return (
        keys.withColumn("_end", frame_times.last_time(F.col("total_frames"), F.col("fps")))
        .withColumn("_wanted", frame_times.tidy_times(wanted))
        .withColumn("times", frame_times.thin_times(F.col("_wanted"), config.max_frames))
        .drop("_end", "_wanted")
    )


def wanted_frames(planned: DataFrame) -> DataFrame:
    """One row per wanted frame of every plan: time, index and index word.

    No plan is empty. The outer explode keeps Spark from inferring a filter on
    the array's size, which would work out every plan a second time.
    """
    return (planned.withColumn("t", F.explode_outer("times")).drop("times")
            .withColumn("idx", frame_times.frame_number(F.col("t"), F.col("fps")))
            .withColumn("word", word_number(F.col("idx"))))


def readable_frames(wanted: DataFrame, words: DataFrame, large: dict[int, int] | None = None,
                    policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Mark each wanted frame with whether it can be read.

    Late hints all fall on the last frames of their video, so one word may be
    wanted by every plan of a video.
    """
    marked = lookup_join(wanted, words, ["id", "word"], spread=["hints", "idx"], how="left",
                         large=large, policy=policy)
    return (marked.withColumn("is_readable", bit_set(F.col("bits"), F.col("idx")))
            .drop("bits", "word"))


def scan_frames(config: EvalConfig) -> Column:
    """Frames a linear scan keeps, as an array of (t, idx, path)."""
    want = frame_times.scan_count(config.frames_per_question, config.max_frames)
    numbers = frame_times.scan_numbers(F.col("readable"), F.col("total_frames"), want)
    return F.transform(numbers, lambda i: F.struct(
        frame_times.scan_time(i, F.col("fps")).alias("t"), i.alias("idx"),
        frame_files.frame_path(F.col("prefix"), frame_files.scan_tag(i)).alias("path")))


def select_frames(keys: DataFrame, facts: DataFrame, words: DataFrame, config: EvalConfig,
                  policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Frames per plan key, from the first source that has any.

    Sought frames come first; a plan without one falls back to the readable
    start of its video, then to the separately grabbed first frame. Keys whose
    id has no file drop out. ``frame_error`` is set where a file cannot be
    opened, or the job fails if the configuration says so. ``keys`` are read
    more than once, so pass a stored table.
    """
    large_ids = large_keys(rows_per_key(keys, ["id"]), ["id"], policy, config.max_frames)
    resolved = lookup_join(keys, facts, ["id"], spread=["hints"], how="inner", large=large_ids,
                           policy=policy)
    wanted = wanted_frames(with_frame_times(resolved, config))
    # Only words of ids with very many plans can be hot, so no others are counted.
    large_words = {} if not large_ids else large_keys(
        rows_per_key(only_keys(wanted, ["id"], large_ids), ["id", "word"]), ["id", "word"], policy)
    marked = readable_frames(wanted, words, large_words, policy)
    carried = [ROWS, "video_path", "fps", "total_frames", "openable", "readable", "first_frame"]
    sought = (marked.groupBy(*KEY, *carried)
              .agg(F.sort_array(F.collect_list(F.when(
                  F.col("is_readable"), F.struct("t", "idx")))).alias("sought")))

    prefix = F.col("prefix")
    problem = F.concat(F.lit("RuntimeError: Cannot open video: "), "video_path")
    if config.on_bad_video == "fail":
        problem = F.raise_error(problem).cast("string")
    found = F.transform("sought", lambda f: F.struct(
        f["t"].alias("t"), f["idx"].alias("idx"),
        frame_files.frame_path(prefix, frame_files.seek_tag(f["t"])).alias("path")))
    grabbed = F.array(F.struct(
        F.lit(0.0).alias("t"), F.lit(0).cast("bigint").alias("idx"),
        frame_files.frame_path(prefix, F.lit(frame_files.FIRST_FRAME_TAG)).alias("path")))

    tier = (F.when(~F.col("openable"), NO_FRAMES)
            .when(F.size("sought") > 0, SEEK)
            .when((F.col("total_frames") > 0) & (F.col("readable") > 0), SCAN)
            .when(F.col("first_frame"), FIRST_FRAME)
            .otherwise(NO_FRAMES))
    frames = (F.when(F.col("tier") == SEEK, found)
              .when(F.col("tier") == SCAN, scan_frames(config))
              .when(F.col("tier") == FIRST_FRAME, grabbed)
              .otherwise(F.array()))
    return (sought.withColumns({"tier": tier,
                                "prefix": frame_files.frame_prefix(F.col("video_path"))})
            .select(*KEY, ROWS, "video_path", "tier", frames.cast(FRAMES_TYPE).alias("frames"),
                    F.when(~F.col("openable"), problem).alias("frame_error")))


def attach_frames(hinted: DataFrame, selected: DataFrame, spread: list[str],
                  keys: DataFrame | None = None, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Bring the frames of its plan key to every question.

    This is the only shuffle of the whole question rows. The counts of
    ``keys``, or those stored with ``selected``, tell the hot keys, so the
    questions are not counted again.
    """
    large = large_keys(selected if keys is None else keys, KEY, policy)
    joined = lookup_join(hinted, selected.drop(ROWS), KEY, spread=spread, how="left",
                         large=large, policy=policy)
    joined = joined.withColumn("frames", F.coalesce("frames", F.array().cast(FRAMES_TYPE)))
    if "urls" in joined.columns:
        joined = joined.withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))
    return joined
