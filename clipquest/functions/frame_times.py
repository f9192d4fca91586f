"""From hints and video metadata to a bounded list of frame times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frame rate of videos that state none, and the gap kept before the end.
DEFAULT_FPS = 25.0
END_GAP = 1e-6

# Splits a double into two halves of at most 26 bits, so that products with
# small integers are exact.
_SPLITTER = 134217729.0


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def effective_fps(fps: Column) -> Column:
    """The stated frame rate, or the default where it is missing or zero."""
    return F.when(F.coalesce(fps, F.lit(0.0)) == 0.0, F.lit(DEFAULT_FPS)).otherwise(fps)


def duration(total_frames: Column, fps: Column) -> Column:
    """Length in seconds; zero for a video without frames."""
    return F.when(total_frames > 0, total_frames / effective_fps(fps)).otherwise(F.lit(0.0))


def last_time(total_frames: Column, fps: Column) -> Column:
    """The latest time a plan may ask for."""
    return F.greatest(F.lit(0.0), duration(total_frames, fps) - END_GAP)


def round_half_even_2(x: Column) -> Column:
    """Round to two decimals by the exact binary value, exact ties to even.

    ``bround`` decides from the shortest decimal text, which calls 2.675 a tie
    although the double lies below it. Values whose third decimal is not a five
    are far from any tie, and plain scaling serves them. For the others the
    sign of ``200 x - (2 q + 1)`` is found without rounding error, with ``q``
    the whole hundredths below ``x``.
    """
    near_tie = F.abs(F.rint(x * 1000.0) % 10.0) == 5.0
    q = F.floor(x * 100.0).cast("double")
    high = x * _SPLITTER - (x * _SPLITTER - x)
    side = (high * 200.0 - (q * 2.0 + 1.0)) + (x - high) * 200.0
    nearest = (F.when(side < 0, q).when(side > 0, q + 1.0)
               .otherwise(F.rint(q / 2.0 + 0.25) * 2.0))
    return F.when(near_tie, nearest).otherwise(F.rint(x * 100.0)) / 100.0


def hinted_times(hints: Column, radius: float, end: Column) -> Column:
    """Each hint with one time before and one after it, kept inside the video."""
    low = F.lit(0.0)
    around = F.transform(hints, lambda t: F.array(*[
        clamp(t + F.lit(float(d)), low, end) for d in (-radius, 0.0, radius)]))
    return F.flatten(around)


def even_times(count: int, end: Column) -> Column:
    """The midpoints of ``count`` equal intervals (at least one)."""
    n = max(1, count)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i + 0.5) / float(n) * end)


def tidy_times(times: Column) -> Column:
    """Two decimals, no repeats, ascending."""
    return F.sort_array(F.array_distinct(F.transform(times, round_half_even_2)))


def thin_times(times: Column, max_total: int) -> Column:
    """At most ``max_total`` times: the first and then every so many.

    Pass a plain column: the step is read again for every element.
    """
    step = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.size(times) / F.lit(max_total)))
    return F.filter(times, lambda _, i: i % step == 0)


def frame_number(t: Column, fps: Column) -> Column:
    """Frame index of a time, halves to even."""
    return F.rint(t * effective_fps(fps)).cast("bigint")


def scan_count(count: int, max_total: int) -> int:
    """How many frames a linear scan looks for."""
    return max(1, min(max_total, count))


def scan_stride(total_frames: Column, want: int) -> Column:
    """Distance between the frames a linear scan keeps."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(total_frames / F.lit(want + 1)))


def scan_numbers(readable: Column, total_frames: Column, want: int) -> Column:
    """Frames kept by a scan that can read the first ``readable`` frames.

    The sequence never has more than ``want`` members, whatever the video's length.
    """
    stride = scan_stride(total_frames, want)
    last = F.least(readable - 1, stride * (want - 1))
    return F.when(readable > 0, F.sequence(F.lit(0).cast("bigint"), last, stride)).otherwise(
        F.array().cast("array<bigint>"))


def scan_time(idx: Column, fps: Column) -> Column:
    """Time of a scanned frame; rates below one count as one."""
    return idx / F.greatest(F.lit(1.0), effective_fps(fps))


def first_frames(frames: Column, cap: int) -> Column:
    """The earliest ``cap`` frames."""
    return F.slice(frames, 1, cap)
