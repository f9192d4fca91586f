import json

import pytest
from pyspark.sql import functions as F

from clipquest.config import EvalConfig
from clipquest.functions import frame_files
from clipquest.operators import frame_store, inference
from clipquest.plans import evaluation
from test_evaluation import items, make_tables, naming_backend  # noqa: F401

CONFIG = EvalConfig.remote(videos_dir="r", frames_per_question=3)
FILES = [(f"r/_frames_-a/-a_{t}.jpg", f"frame_{t}".encode()) for t in (8000, 10000, 12000, "ls0", "ls25")]


@pytest.fixture
def packed(spark, tmp_path):
    files = spark.createDataFrame([*FILES, (None, b"x"), ("none", None)], "path string, content binary")
    return frame_store.pack_frames(files, str(tmp_path / "packed"), buckets=3)


def answers_of(df):
    return {r.pos: (r.model_answer, r.model_raw, r.model_rationale) for r in df.collect()}


def test_same_answers_as_with_a_table_of_contents(spark, items, packed, tmp_path):  # noqa: F811
    files = spark.createDataFrame(FILES, "path string, content binary")
    expected = answers_of(evaluation.evaluate(items, make_tables(spark), naming_backend(decode=True), CONFIG,
                                              frame_files=files))
    for path, content in FILES:
        target = tmp_path / "folder" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    for store in (packed, frame_store.FolderFrames(str(tmp_path / "folder")),
                  frame_store.FolderFrames(f"file://{tmp_path}/folder")):
        found = evaluation.evaluate(items, make_tables(spark), naming_backend(decode=True), CONFIG,
                                    frame_store=store)
        assert answers_of(found) == expected
    assert expected[0][2] == "Because 8000,10000,12000"
    assert expected[2][1] == "[ERROR] FileNotFoundError: r/_frames_-a/-a_ls50.jpg"


def test_no_image_bytes_are_stored_or_shuffled(spark, items, packed, monkeypatch):  # noqa: F811
    stored = []
    for module in (inference, evaluation):
        kept = module.materialize

        def spy(df, label, *args, kept=kept):
            plan = df._jdf.queryExecution().executedPlan().toString()
            out = kept(df, label, *args)
            stored.append((label, plan, out.columns, str(out.limit(50).toJSON().collect())))
            return out

        monkeypatch.setattr(module, "materialize", spy)
    evaluation.evaluate(items, make_tables(spark), naming_backend(decode=True), CONFIG, frame_store=packed).collect()
    assert {"lenient-pass-1", "frames"} <= {label for label, *_ in stored}
    for label, plan, columns, rows in stored:
        assert not {"urls", "content"} & set(columns), label
        assert "base64" not in plan and "data:" not in rows and "content#" not in plan, label


def request(*paths):
    return {"messages": [{"role": "user", "content": [{"type": "text", "text": "q", "refs": None}] + [
        {"type": "input_image", "text": None, "refs": [p]} for p in paths]}], "question_type": "Yes/No"}


def test_each_path_is_fetched_once_a_call_and_kept(monkeypatch):
    asked, seen = [], []

    def make_store():
        def fetch(paths):
            asked.append(list(paths))
            return {p: p.encode() * 10 for p in paths if p != "lost"}
        return fetch

    def make_backend():
        def backend(requests):
            seen.append([[r for part in q["messages"][0]["content"] for r in part["refs"] or ()] for q in requests])
            return ["Yes"] * len(requests)
        return backend

    backend = frame_store.fetching_backend(make_backend, make_store, cache_bytes=150)()
    replies = backend([request("a.png", "b"), request("b", "lost"), request(), request("b")])
    assert asked == [["a.png", "b", "lost"]]
    assert [type(r) for r in replies] == [str, FileNotFoundError, str, str] and str(replies[1]) == "lost"
    assert [len(refs) for refs in seen[0]] == [2, 0, 1]
    assert seen[0][0][0].startswith("data:image/png;base64,") and seen[0][0][1] == seen[0][2][0]
    backend([request("b")])
    assert len(asked) == 1  # still kept
    backend([request("c", "d", "e")])
    backend([request("b")])
    assert asked[1:] == [["c", "d", "e"], ["b"]]  # pushed out
    assert backend([request("lost")]) and len(seen) == 4  # nothing left to ask


def test_urls_are_those_of_the_expression(spark):
    rows = [("a.b/c.PNG", b"\x00\xff" * 100), ("x", b""), ("d.tiff/e", b"1"), ("f.svg", b"12")]
    df = spark.createDataFrame(rows, "path string, content binary")
    found = df.select("path", frame_files.data_url(F.col("content"), F.col("path")).alias("url")).collect()
    assert {r.path: r.url for r in found} == {p: frame_store.data_url(p, c) for p, c in rows}


def test_paths_in_order_read_each_row_group_once(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    names = [f"r/{n:05}.jpg" for n in range(6000)]
    files = spark.createDataFrame([(n, n.encode() * 30) for n in names], "path string, content binary")
    packed = frame_store.pack_frames(files, str(tmp_path / "packed"), buckets=2, row_group=20_000)
    read, whole = [], pq.ParquetFile.read_row_group

    def spy(self, i, *args, **kwargs):
        read.append((id(self), i))
        return whole(self, i, *args, **kwargs)

    monkeypatch.setattr(pq.ParquetFile, "read_row_group", spy)
    fetch = packed()
    for start in range(0, len(names), 50):
        wanted = names[start:start + 50]
        assert fetch([*wanted, "none", "r/00000.jpg0", "~"]) == {n: n.encode() * 30 for n in wanted}
    # A name that is absent may fall into a row group's range.
    assert len(set(read)) > 8 and len(read) < len(set(read)) + 2 * 120
    read.clear()
    fetch = packed()
    for start in range(0, len(names), 50):
        fetch(names[start:start + 50])
    assert len(read) == len(set(read)) > 8
    assert packed()(names[::-7]) == {n: n.encode() * 30 for n in names[::-7]}


def test_row_groups_without_bounds_are_searched(spark, tmp_path):
    names = ["r/" + "x" * 5000 + str(n) for n in range(40)] + ["a", "z"]
    files = spark.createDataFrame([(n, n.encode()) for n in names], "path string, content binary")
    packed = frame_store.pack_frames(files, str(tmp_path / "packed"), buckets=1, row_group=20_000)
    assert packed()([*names, "none"]) == {n: n.encode() for n in names}


def test_tasks_take_ranges_of_frames(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("pos"), F.array(F.struct(F.when(
            F.col("id") % 10 > 0, F.concat(F.lit("f"), F.crc32(F.col("id").cast("string")) % 300)).alias("path"))
        ).alias("frames"))
    dealt = inference.Dealing(partitions=5, by_frames=True).deal(rows, 3000)
    tasks = dealt.select(F.spark_partition_id().alias("task"), F.col("frames.path")[0].alias("path"), "pos").collect()
    paths = [[r.path or "" for r in tasks if r.task == n] for n in range(5)]
    assert len({r.pos for r in tasks}) == len(tasks) == 3000
    assert sum(paths, []) == sorted(sum(paths, [])) and min(map(len, paths)) > 200
