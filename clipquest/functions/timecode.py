"""Timecodes in question and reply text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two or three two-digit fields, not glued to other word characters.
TIMECODE = r"(?U)\b([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?\b"


def extract_timecodes(text: Column) -> Column:
    """All timecodes of a text, left to right, as ``array<string>``."""
    return F.regexp_extract_all(text, F.lit(TIMECODE), F.lit(0))


def has_timecode(text: Column) -> Column:
    """Whether a text holds a timecode; NULL counts as no."""
    return F.coalesce(text, F.lit("")).rlike(TIMECODE)


def first_timecode(text: Column) -> Column:
    """The leftmost timecode, or NULL."""
    return F.nullif(F.regexp_extract(text, TIMECODE, 0), F.lit(""))


def clock_seconds(timecode: Column, two_field: str = "hhmm") -> Column:
    """Whole seconds of a string that is exactly one timecode."""

    def part(start: int) -> Column:
        return F.substring(timecode, start, 2).cast("bigint")

    first, second = part(1), part(4)
    third = F.when(F.length(timecode) > 5, part(7))
    long_form = first * 3600 + second * 60 + F.coalesce(third, F.lit(0))
    if two_field == "hhmm":
        return long_form
    return F.when(third.isNull(), first * 60 + second).otherwise(long_form)


def timecode_seconds(text: Column, two_field: str = "hhmm") -> Column:
    """Seconds of the leftmost timecode in a text, or NULL."""
    return clock_seconds(first_timecode(text), two_field)


def hint_seconds(text: Column, two_field: str = "hhmm") -> Column:
    """Ascending seconds of all timecodes in a text; repeats are kept."""
    seconds = F.transform(extract_timecodes(text), lambda tc: clock_seconds(tc, two_field))
    return F.sort_array(F.filter(seconds, lambda s: s >= 0))
