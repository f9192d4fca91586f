import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import restated
from clipquest.config import EvalConfig
from clipquest.functions import frame_times as ft
from clipquest.operators.frames import with_frame_times

GOLDEN = [
    # fps, frames, hints, n, max, times, indices
    (25.0, 3000, [], 4, 16, [15.0, 45.0, 75.0, 105.0], [375, 1125, 1875, 2625]),
    (25.0, 3000, [60], 12, 16, [58.0, 60.0, 62.0], [1450, 1500, 1550]),
    (25.0, 3000, [0, 1], 12, 16, [0.0, 1.0, 2.0, 3.0], [0, 25, 50, 75]),
    (25.0, 3000, [780], 12, 16, [120.0], [3000]),
    (0.0, 250, [], 2, 16, [2.5, 7.5], [62, 188]),
    (30.0, 0, [5], 12, 16, [0.0], [0]),
    (30.0, 900, [], 25, 24, [round(0.6 + 2.4 * i, 2) for i in range(13)],
     [18 + 72 * i for i in range(13)]),
    (25.0, 3000, [], 0, 16, [60.0], [1500]),
]


def planned(spark, cases):
    """Plans of (fps, frames, hints, n, max) cases, grouped by their parameters."""
    out = {}
    for n, most in {c[3:5] for c in cases}:
        rows = [(i, c[2], c[0], c[1]) for i, c in enumerate(cases) if c[3:5] == (n, most)]
        df = spark.createDataFrame(rows, "i int, hints array<bigint>, fps double, total_frames bigint")
        config = EvalConfig.strict(frames_per_question=n, max_frames=most)
        got = with_frame_times(df, config).withColumn(
            "idx", F.transform("times", lambda t: ft.frame_number(t, F.col("fps"))))
        out.update({r["i"]: (r["times"], r["idx"]) for r in got.collect()})
    return [out[i] for i in range(len(cases))]


def test_golden_plans(spark):
    assert planned(spark, GOLDEN) == [(c[5], c[6]) for c in GOLDEN]


def test_random_plans(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(1500):
        hints = sorted(rng.choices(range(0, 7200, rng.choice([1, 60])), k=rng.choice([0, 0, 1, 2, 9])))
        cases.append((rng.choice([0.0, 23.976, 25.0, 29.97, 59.94, 0.5]), rng.choice(
            [0, 1, 7, 250, 4321, rng.randrange(200_000)]), hints, *rng.choice([(12, 16), (61, 24), (3, 5)])))
    expected = [restated.plan(h, fps, total, n, 2.0, most) for fps, total, h, n, most in cases]
    assert planned(spark, cases) == [
        ([t for t, _ in e], [i for _, i in e]) for e in expected]


def test_missing_rate_counts_as_zero(spark):
    df = spark.createDataFrame([(None, 50)], "fps double, n bigint")
    row = df.select(ft.effective_fps(F.col("fps")), ft.duration(F.col("n"), F.col("fps"))).first()
    assert tuple(row) == (25.0, 2.0)


def some_times(rng):
    """Values in general position, on decimal ties and on exact binary ties."""
    return rng.choice([
        lambda: rng.uniform(0, 400_000), lambda: rng.randrange(2_000_000) * 0.005,
        lambda: rng.randrange(2_000_000) / 8, lambda: rng.randrange(40_000_000) / 1000,
        lambda: rng.randrange(1000) + rng.choice([2.675, 0.005, 0.015, 1e-6, 0.994999999]),
        lambda: -rng.randrange(20_000) / 200])()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 2**32))
def test_rounding_is_exact(spark, seed):
    rng = random.Random(seed)
    xs = [some_times(rng) for _ in range(5000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r[0]: r[1] for r in df.select("i", ft.round_half_even_2(F.col("x"))).collect()}
    assert [got[i] for i in range(len(xs))] == [round(x, 2) for x in xs]


def test_long_scans_stay_small(spark):
    df = spark.createDataFrame([(10**12, 10**12)], "readable bigint, n bigint")
    got = df.select(ft.scan_numbers(F.col("readable"), F.col("n"), 12)).first()[0]
    stride = 10**12 // 13
    assert got == [i * stride for i in range(12)]
