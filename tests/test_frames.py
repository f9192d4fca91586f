import random

import pytest
from pyspark.sql import functions as F

import restated
from clipquest.config import EvalConfig
from clipquest.operators import frames as frame_ops
from clipquest.operators.frame_index import frame_words, readable_prefix
from clipquest.operators.skew import SkewPolicy

CONFIG = EvalConfig.strict(frames_per_question=5, max_frames=7)
KEYS = "id string, hints array<bigint>, _rows bigint"


def random_videos(seed, count):
    rng = random.Random(seed)
    videos, index, first = {}, {}, set()
    for i in range(count):
        vid = f"v{i}"
        total = rng.choice([0, 0, 1, 3, 40, 130, 400])
        density = rng.choice([0.0, 0.02, 0.5, 1.0])
        readable = {j for j in range(int(total * 1.1)) if rng.random() < density}
        if rng.random() < 0.5:
            readable |= set(range(rng.choice([1, 5, 60, 61, 120, 200])))
        videos[vid] = (rng.choice([0.0, 1.0, 2.0, 12.5, 29.97]), total)
        index[vid] = readable
        if rng.random() < 0.5:
            first.add(vid)
    return rng, videos, index, first


def tables(spark, videos, index, first):
    assets = spark.createDataFrame([(v, f"r/{v}.mp4") for v in videos], "id string, video_path string")
    # A video listed twice, once with fewer frames, is one video.
    listed = [(v, *x) for v, x in videos.items()] + [(v, 7.0, x[1] - 1) for v, x in videos.items()]
    table = spark.createDataFrame(listed, "id string, fps double, total_frames bigint")
    # Every frame twice: the index is a set.
    rows = [(v, i) for v, ids in index.items() for i in ids] * 2
    words = frame_words(spark.createDataFrame(rows, "id string, idx bigint"))
    grabbed = spark.createDataFrame([(v,) for v in first], "id string")
    return frame_ops.video_facts(assets, table, first_frame=grabbed, words=words), words


def expected_frames(hints, fps, total, readable, has_first):
    plan = restated.plan(hints, fps, total, 5, 2.0, 7)
    sought = [(t, i) for t, i in plan if i in readable]
    if sought:
        return frame_ops.SEEK, sought
    scanned = restated.scan(readable, fps, total, 5, 7) if total > 0 else []
    if scanned:
        return frame_ops.SCAN, scanned
    return (frame_ops.FIRST_FRAME, [(0.0, 0)]) if has_first else (frame_ops.NO_FRAMES, [])


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(rows_per_slice=3, max_hot_keys=50)])
def test_tiers_against_brute_force(spark, policy):
    rng, videos, index, first = random_videos(11, 250)
    keys = {(v, tuple(sorted(rng.choices(range(0, 40), k=rng.choice([0, 1, 2, 4])))))
            for v in list(videos) + ["v0"] * 40 + ["unknown"] for _ in range(3)}
    facts, words = tables(spark, videos, index, first)
    df = spark.createDataFrame([(v, list(h), 1) for v, h in keys], KEYS)
    got = frame_ops.select_frames(df, facts, words, CONFIG, policy).collect()
    assert len(got) == sum(v != "unknown" for v, _ in keys)
    tiers = set()
    for row in got:
        fps, total = videos[row["id"]]
        tier, frames = expected_frames(list(row["hints"]), fps, total, index[row["id"]],
                                       row["id"] in first)
        assert (row["tier"], [(f["t"], f["idx"]) for f in row["frames"]]) == (tier, frames), row
        tiers.add(tier)
    assert tiers == {0, 1, 2, 3}


def test_frame_names_by_tier(spark):
    videos = {"s": (1.0, 4), "l": (1.0, 30), "f": (1.0, 4)}
    facts, words = tables(spark, videos, {"s": {1, 2}, "l": {0, 1}, "f": set()}, {"f"})
    keys = spark.createDataFrame([("s", [2], 1), ("l", [25], 1), ("f", [], 1)], KEYS)
    rows = frame_ops.select_frames(keys, facts, words, CONFIG).collect()
    assert {r["id"]: [f["path"] for f in r["frames"]] for r in rows} == {
        "s": ["r/_frames_s/s_2000.jpg"], "l": ["r/_frames_l/l_ls0.jpg"],
        "f": ["r/_frames_f/f_ff0.jpg"]}


def test_readable_prefix(spark):
    index = {"none": {5}, "one": {0}, "word": set(range(60)), "two": set(range(120)),
             "gap": set(range(300)) - {200}, "hole": set(range(60)) | set(range(120, 180)),
             "late": set(range(61, 200)), "long": set(range(1000))}
    rows = [(v, i) for v, ids in index.items() for i in ids] + [("none", -1)]
    got = readable_prefix(frame_words(spark.createDataFrame(rows, "id string, idx bigint")))
    assert dict(map(tuple, got.collect())) == {
        "none": 0, "one": 1, "word": 60, "two": 120, "gap": 200, "hole": 60, "late": 0, "long": 1000}


def test_videos_that_cannot_be_opened(spark):
    facts, words = tables(spark, {"a": (1.0, 4)}, {"a": {0}}, {"a"})
    facts = facts.unionByName(facts.withColumns({
        "id": F.lit("bad"), "video_path": F.lit("r/bad.mp4"), "openable": F.lit(False)}))
    keys = spark.createDataFrame([("a", [], 1), ("bad", [], 1)], KEYS)
    rows = {r["id"]: r for r in frame_ops.select_frames(keys, facts, words, CONFIG).collect()}
    assert rows["bad"]["frame_error"] == "RuntimeError: Cannot open video: r/bad.mp4"
    assert rows["bad"]["frames"] == [] and rows["a"]["frame_error"] is None
    fail = EvalConfig.strict(on_bad_video="fail")
    with pytest.raises(Exception, match="Cannot open video"):
        frame_ops.select_frames(keys, facts, words, fail).collect()
