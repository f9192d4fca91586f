import json

import pytest
from pyspark.sql import functions as F

from clipquest.config import EvalConfig
from clipquest.operators import frames
from clipquest.operators.items import valid_items
from clipquest.operators.skew import SkewPolicy
from clipquest.plans import evaluation
from clipquest.sources import answers, questions
from clipquest.sources.assets import assets_from_paths
from clipquest.session import materialize
from clipquest.streaming.questions import answer_stream, read_question_stream


def naming_backend(decode=False):
    """A model that says Yes and names the frames it was shown."""

    def make():
        import base64

        def name(ref):
            if decode:
                ref = base64.b64decode(ref.removeprefix("data:image/jpeg;base64,")).decode()
            return ref.rsplit("_", 1)[1]

        def backend(requests):
            out = []
            for request in requests:
                parts = [p for m in request["messages"] for p in m["content"]]
                refs = [name(r) for p in parts if p["refs"] for r in p["refs"]]
                out.append("Yes. Because " + ",".join(refs))
            return out

        return backend

    return make


shown_frames = naming_backend()


def make_tables(spark):
    return evaluation.VideoTables(
        assets_from_paths(spark.createDataFrame([("-a.mp4",), ("_b/x.mkv",)], "rel_path string")),
        spark.createDataFrame([("-a", 1.0, 100), ("_b", 0.0, 50)], "id string, fps double, total_frames bigint"),
        spark.range(100).select(F.lit("-a").alias("id"), F.col("id").alias("idx")).unionByName(
            spark.range(3).select(F.lit("_b").alias("id"), F.col("id").alias("idx"))))


ITEMS = [
    {"id": "-a", "question_type": "Yes/No", "question": "Same at 00:00:10?", "answer": "Yes", "x": 1},
    {"id": "-a", "question_type": "Yes/No", "question": "Same again at 00:00:10?", "answer": "No"},
    {"id": "-a", "question_type": "Yes/No", "question": "At 00:13?", "answer": "No"},
    {"id": "_b", "question_type": "Yes/No", "question": "Ever?", "answer": "No"},
    {"id": "zz", "question_type": "Yes/No", "question": "Where?", "answer": "No"},
    {"id": "zz", "question_type": "", "question": "Bad", "answer": "No"},
]
EXPECTED = {
    0: ("Because 8000.jpg,10000.jpg,12000.jpg", "r/-a.mp4"),
    1: ("Because 8000.jpg,10000.jpg,12000.jpg", "r/-a.mp4"),
    # 13 minutes: past the end, so the scan takes over; frames 0, 25, 50, 75 of 100.
    2: ("Because ls0.jpg,ls25.jpg,ls50.jpg", "r/-a.mp4"),
    3: ("Because ls0.jpg", "r/_b/x.mkv"),
    4: (None, None),
}
CONFIG = EvalConfig.strict(videos_dir="r", frames_per_question=3)


@pytest.fixture
def items(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps(ITEMS))
    return questions.read_json_array(spark, str(path))


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(rows_per_slice=1)])
def test_whole_evaluation(spark, items, policy):
    rows = evaluation.evaluate(items, make_tables(spark), shown_frames, CONFIG, policy).collect()
    assert {r["pos"]: (r["model_rationale"], r["video_path"]) for r in rows} == EXPECTED
    assert {r["model_answer"] for r in rows} == {"Yes"}
    assert {r["answer"] for r in rows} == {"Yes", "No"}


def test_results_without_rationale_as_json(spark, items, tmp_path):
    config = EvalConfig.lenient(videos_dir="r", keep_rationale=False)
    done = evaluation.evaluate(items, make_tables(spark), shown_frames, config)
    answers.write_json_array(done, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    out = json.loads(text)
    assert [o["question"] for o in out] == [i["question"] for i in ITEMS[:5]]
    assert out[0]["x"] == 1 and "model_rationale" not in out[0] and "video_path" not in out[4]


def test_stored_frames_serve_several_runs(spark, items):
    tables = make_tables(spark)
    stored = materialize(evaluation.frame_table(items, tables, CONFIG), "frames")
    assert stored.count() == 3
    again = evaluation.prepare(items, tables, CONFIG, selected=stored)
    fresh = evaluation.prepare(items, tables, CONFIG)
    assert sorted(again.collect(), key=str) == sorted(fresh.select(again.columns).collect(), key=str)


def test_remote_frames_as_data_urls(spark, items):
    config = EvalConfig.remote(videos_dir="r", frames_per_question=3)
    files = spark.createDataFrame(
        [(f"r/_frames_-a/-a_{t}.jpg", f"frame_{t}".encode()) for t in (8000, 10000, 12000)],
        "path string, content binary")
    rows = evaluation.evaluate(items.filter("pos < 1"), make_tables(spark), naming_backend(decode=True),
                               config, frame_files=files).collect()
    assert [r["model_rationale"] for r in rows] == ["Because 8000,10000,12000"]


def test_question_rows_shuffle_once(spark, items):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prepared = evaluation.prepare(items, make_tables(spark), CONFIG)
        plan = prepared._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    # The left side of the last join ends where its right side is sorted.
    questions_side = plan.split("Sort [")[1]
    assert questions_side.count("Exchange") == 1 and "FileScan text" in questions_side


def test_plan_keys_read_little(spark, items, tmp_path):
    items.write.parquet(str(tmp_path / "items"))
    stored = questions.read_table(spark, str(tmp_path / "items"))
    keys = frames.plan_keys(frames.with_hints(valid_items(stored), CONFIG))
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,question_type:string,question:string>" in plan
    assert "PushedFilters: [IsNotNull(id), IsNotNull(question), IsNotNull(question_type), " in plan
    assert plan.count("partial_count") == 1
    assert [tuple(r) for r in keys.filter("id = 'zz'").collect()] == [("zz", [], 1)]


def test_stream_of_files(spark, tmp_path):
    arriving = tmp_path / "in"
    arriving.mkdir()
    (arriving / "one.jsonl").write_text("\n".join(map(json.dumps, ITEMS[:3])))
    (arriving / "two.jsonl").write_text("\n".join(map(json.dumps, ITEMS[3:])))
    tables, out = make_tables(spark), tmp_path / "answers"

    def answer(batch):
        return evaluation.evaluate(batch, tables, shown_frames, CONFIG)

    def run():
        stream = read_question_stream(spark, str(arriving), files_per_batch=1)
        query = answer_stream(stream, answer, str(out), str(tmp_path / "state"))
        query.awaitTermination(300)
        return spark.read.parquet(str(out))

    rows = run().collect()
    assert {r["batch"] for r in rows} == {0, 1} and len(rows) == 5
    (arriving / "three.jsonl").write_text(json.dumps({**ITEMS[0], "question": "New at 00:00:50?"}))
    assert run().count() == 6
