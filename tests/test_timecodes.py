import pytest
from pyspark.sql import functions as F

from clipquest.functions import timecode as tc

CASES = [
    ("at 00:13", ["00:13"], 780, 13),
    ("01:02:03", ["01:02:03"], 3723, 3723),
    ("01:02:03:04", ["01:02:03"], 3723, 3723),
    ("12:34:5", ["12:34"], 45240, 754),
    ("00:99", ["00:99"], 5940, 99),
    ("123:45", [], None, None),
    ("12:345", [], None, None),
    ("a12:34", [], None, None),
    ("12:34b", [], None, None),
    ("_12:34", [], None, None),
    ("é12:34", [], None, None),
    ("00:05 then (01:45), 00:05.", ["00:05", "01:45", "00:05"], 300, 5),
    ("", [], None, None),
    (None, None, None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "n int, text string")
    text = F.col("text")
    return df.select(
        "n", tc.extract_timecodes(text).alias("found"), tc.timecode_seconds(text).alias("hhmm"),
        tc.timecode_seconds(text, "mmss").alias("mmss"), tc.has_timecode(text).alias("has"),
        tc.hint_seconds(text, "mmss").alias("hints")).orderBy("n").collect()


def test_extraction(rows):
    assert [r["found"] for r in rows] == [c[1] for c in CASES]


def test_seconds(rows):
    assert [r["hhmm"] for r in rows] == [c[2] for c in CASES]
    assert [r["mmss"] for r in rows] == [c[3] for c in CASES]


def test_presence_is_null_safe(rows):
    assert [r["has"] for r in rows] == [bool(c[1]) for c in CASES]


def test_hints_are_sorted_and_keep_repeats(rows):
    assert rows[11]["hints"] == [5, 5, 105]
