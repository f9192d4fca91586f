import base64
import glob
import json

import pytest
from pyspark.sql import functions as F

from clipquest.functions import frame_files as ff
from clipquest.operators import assets as asset_ops
from clipquest.operators.items import item_key, observe_items, rejected_items, valid_items, with_answers
from clipquest.sources import answers, assets, frames, questions

ITEMS = [
    {"id": "-a1", "question_type": "Yes/No", "question": "Is it the same at 00:13?", "answer": "Yes",
     "extra": {"n": [1, "2", None]}, "score": 1.5},
    {"id": "", "question_type": "Yes/No", "question": "No id", "answer": "No"},
    {"id": "_b", "question_type": "Timestamp", "question": "   ", "answer": "00:13"},
    {"id": "c", "question_type": None, "question": "No type"},
    {"id": "d", "question": "Missing type"},
    {"id": "ünï", "question_type": "True/False", "question": "\"Quoted\"\nline é", "answer": "True",
     "model_answer": "stale"},
]


@pytest.fixture
def items(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps(ITEMS, indent=2))
    return questions.read_json_array(spark, str(path))


def test_array_keeps_order_and_unknown_keys(items):
    rows = items.orderBy("pos").collect()
    assert [r["id"] for r in rows] == [i["id"] for i in ITEMS]
    assert json.loads(rows[0]["item_json"]) == ITEMS[0]
    assert rows[4]["question_type"] is None


def test_lines_give_the_same_items(spark, tmp_path, items):
    path = tmp_path / "items.jsonl"
    path.write_text("\n".join(map(json.dumps, ITEMS)))
    lines = questions.read_json_lines(spark, str(path)).orderBy("pos")
    columns = ["id", "question_type", "question", "answer"]
    assert lines.select(columns).collect() == items.orderBy("pos").select(columns).collect()


def test_only_incomplete_items_are_rejected(items):
    assert [r["id"] for r in valid_items(items).orderBy("pos").collect()] == ["-a1", "_b", "ünï"]
    assert [(r["id"], r["missing"]) for r in rejected_items(items).orderBy("pos").collect()] == [
        ("", "id"), ("c", "question_type"), ("d", "question_type")]


def answered(items, keep_rationale=True):
    return with_answers(
        valid_items(items), F.lit("No"), F.lit("No. Really"),
        F.when(F.col("id") == "-a1", "Because").otherwise(""),
        F.when(F.col("id") != "_b", F.concat(F.lit("v/"), "id", F.lit(".mp4"))), keep_rationale)


def expected(item, keep_rationale=True):
    out = {**item, "model_answer": "No", "model_raw": "No. Really"}
    if item["id"] == "-a1" and keep_rationale:
        out["model_rationale"] = "Because"
    if item["id"] != "_b":
        out["video_path"] = f"v/{item['id']}.mp4"
    return out


@pytest.mark.parametrize("keep_rationale", [True, False])
def test_array_round_trip(spark, tmp_path, items, keep_rationale):
    out = tmp_path / "array"
    answers.write_json_array(answered(items, keep_rationale), str(out))
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{out}/part-*")))
    assert json.loads(text) == [expected(ITEMS[i], keep_rationale) for i in (0, 2, 5)]


def test_empty_array(tmp_path, items):
    answers.write_json_array(answered(items).filter("false"), str(tmp_path / "none"))
    text = "".join(open(p).read() for p in glob.glob(f"{tmp_path}/none/part-*"))
    assert json.loads(text) == []


def test_lines_and_parquet_sinks(spark, tmp_path, items):
    done = answered(items)
    answers.write_json_lines(done, str(tmp_path / "lines"))
    rows = [json.loads(line) for p in glob.glob(f"{tmp_path}/lines/part-*") for line in open(p)]
    assert sorted(rows, key=lambda r: r["id"]) == sorted(
        (expected(ITEMS[i]) for i in (0, 2, 5)), key=lambda r: r["id"])
    answers.write_parquet(done, str(tmp_path / "table"))
    assert questions.read_table(spark, str(tmp_path / "table")).count() == 3


def test_items_without_raw_text(items):
    row = answers.with_answered_json(answered(items).drop("item_json").filter("id = '_b'")).first()
    assert json.loads(row["answered_json"]) == expected(ITEMS[2])


def test_counters_while_writing(spark, tmp_path, items):
    from pyspark.sql import Observation

    seen = Observation("items")
    done = items.withColumns({"model_answer": F.when(F.col("pos") == 0, "").otherwise("Yes"),
                              "video_path": F.when(F.col("id") == "-a1", "p")})
    observe_items(done, seen).write.parquet(str(tmp_path / "seen"))
    assert seen.get == {"items": 6, "skipped": 3, "without_video": 2, "empty_answers": 1}


FILES = ["a.mkv", "a.mp4", "a/z.mp4", "b/q.mov", "b/p.mkv", "b/o.mkv", "c/d/e.mp4", "d.MP4", "_e.mp4",
         "_f/x.mov", "g.mp4.txt", "-h.mov", "h i.mp4", ".mp4"]
# An id may hold a slash: it is a path without the extension, or a folder.
BEST = {"a": "r/a.mp4", "b": "r/b/o.mkv", "_e": "r/_e.mp4", "_f": "r/_f/x.mov", "-h": "r/-h.mov",
        "h i": "r/h i.mp4", "a/z": "r/a/z.mp4", "b/q": "r/b/q.mov", "b/p": "r/b/p.mkv",
        "b/o": "r/b/o.mkv", "_f/x": "r/_f/x.mov"}
DEEPER = {"c/d": "r/c/d/e.mp4", "c/d/e": "r/c/d/e.mp4"}


def test_best_assets_from_an_inventory(spark):
    paths = spark.createDataFrame([(f,) for f in FILES], "rel_path string")
    found = asset_ops.best_assets(assets.assets_from_paths(paths), "r/").collect()
    assert dict(map(tuple, found)) == BEST | DEEPER


def test_best_assets_from_a_folder(spark, tmp_path):
    for name in FILES:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    found = asset_ops.best_assets(assets.scan_assets(spark, str(tmp_path)), "r").collect()
    assert dict(map(tuple, found)) == BEST


def test_unmatched_items_stay(spark, items):
    paths = spark.createDataFrame([("_b/x.mov",)], "rel_path string")
    best = asset_ops.best_assets(assets.assets_from_paths(paths), "r")
    rows = asset_ops.resolve_videos(items.filter("id <> ''"), best, ["pos"]).collect()
    assert {r["id"]: r["video_path"] for r in rows} == {
        "-a1": None, "_b": "r/_b/x.mov", "c": None, "d": None, "ünï": None}


@pytest.mark.parametrize("path, tag, expected", [
    ("v/a.mp4", "15000", "v/_frames_a/a_15000.jpg"),
    ("v/b/p.q.mkv", "ls3", "v/b/_frames_p.q/p.q_ls3.jpg"),
    ("a.mov", "ff0", "_frames_a/a_ff0.jpg"),
])
def test_frame_paths(spark, path, tag, expected):
    assert spark.range(1).select(ff.frame_path(ff.frame_prefix(F.lit(path)), F.lit(tag))).first()[0] == expected


def test_tags_round_half_to_even(spark):
    row = spark.range(1).select(ff.seek_tag(F.lit(0.0005)), ff.seek_tag(F.lit(1.23)),
                                ff.seek_tag(F.lit(0.0015))).first()
    assert tuple(row) == ("0", "1230", "2")


def test_data_urls_of_stored_frames(spark, tmp_path):
    folder = tmp_path / "_frames_a"
    folder.mkdir()
    bodies = {f"a_{i}.jpg": bytes(range(i, 200)) for i in range(3)}
    for name, body in bodies.items():
        (folder / name).write_bytes(body)
    files = frames.read_frame_files(spark, str(folder)).withColumn(
        "path", F.regexp_replace("path", "^file:", ""))
    names = sorted(bodies)
    rows = [("k", [(float(i), i, f"{folder}/{n}") for i, n in enumerate(names)], None), ("none", [], None),
            ("lost", [(0.0, 0, f"{folder}/a_0.jpg"), (1.0, 1, "gone"), (2.0, 2, "past the cap")], None),
            ("bad", [(0.0, 0, "gone")], "RuntimeError: x")]
    selected = spark.createDataFrame(
        rows, "id string, frames array<struct<t: double, idx: bigint, path: string>>, frame_error string")
    found = frames.with_data_urls(selected, files, ["id"], 2).collect()
    urls = ["data:image/jpeg;base64," + base64.b64encode(bodies[n]).decode() for n in names[:2]]
    assert {r["id"]: r["urls"] for r in found} == {"none": [], "k": urls, "lost": urls[:1], "bad": []}
    assert {r["id"]: r["frame_error"] for r in found} == {
        "none": None, "k": None, "lost": "FileNotFoundError: gone", "bad": "RuntimeError: x"}


def test_files_without_an_array_are_reported(spark, tmp_path):
    texts = {"good": '[{"id": "a", "question": "q", "question_type": "Yes/No"}]', "empty": "[]",
             "cut": '[{"id": "a"}, {"id"', "single": '{"id": "a"}', "none": " "}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = questions.read_json_array(spark, str(tmp_path))
    bad = rejected_items(found).filter("file_error is not null").collect()
    assert {r["source"].rpartition("/")[2] for r in bad} == {"cut.json", "single.json", "none.json"}
    assert {(r["pos"], r["file_error"]) for r in bad} == {(0, questions.NOT_AN_ARRAY)}
    assert valid_items(found).count() == 1 and found.count() == 4
    with pytest.raises(Exception, match="not a JSON array"):
        questions.read_json_array(spark, str(tmp_path), on_bad_file="fail").collect()


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    for name, count in (("c", 3), ("a", 50), ("b", 400)):
        (tmp_path / f"{name}.jsonl").write_text("".join(
            json.dumps({"id": f"{name}{i}", "question": "q" * 50, "question_type": "t"}) + "\n"
            for i in range(count)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = questions.read_json_lines(spark, str(tmp_path))
        assert item_key(lines) == ("source", "offset", "pos")
        ids = [r["id"] for r in lines.orderBy(*item_key(lines)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == [f"{n}{i}" for n, count in (("a", 50), ("b", 400), ("c", 3)) for i in range(count)]


def test_values_that_count_as_nothing(spark, tmp_path):
    values = [0, 0.0, -0.0, False, [], {}, None, "", "0", "false", "[]", 1, True, 2.5, [0]]
    path = tmp_path / "falsy.json"
    path.write_text(json.dumps([{"id": v, "question": "q", "question_type": "t"} for v in values]))
    kept = valid_items(questions.read_json_array(spark, str(path))).orderBy("pos").collect()
    assert [r["pos"] for r in kept] == [i for i, v in enumerate(values) if v]
    assert [r["id"] for r in kept] == ["0", "false", "[]", "1", "true", "2.5", "[0]"]


def test_many_arrays_become_one(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"part{n:02}.json").write_text(json.dumps(
            [{"id": f"{n}-{i}", "question": "q", "question_type": "t"} for i in range(5)]))
    done = answered(questions.read_json_array(spark, str(tmp_path)))
    assert answers.write_json_array(done, str(tmp_path / "out")) == 200
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/out/part-*")))
    assert [r["id"] for r in json.loads(text)] == [f"{n}-{i}" for n in range(40) for i in range(5)]
    with pytest.raises(ValueError, match="rows have the key"):
        answers.write_json_array(done, str(tmp_path / "again"), order=("pos",))
    assert not (tmp_path / "again").exists()


def test_answers_are_put_into_the_text(spark):
    big = "1234567890123456789012345678901234567890123"
    texts = ['{"x":1,"x":2}', f'{{"n": {big}, "e": 1e400}}', "{}", ' {"a": [1, {"b": "}"}]} \n',
             '{"model_raw": 1, "z": "é"}', '{"model_raw": 1, "model_raw": 2}', "[1]", None]
    df = spark.createDataFrame(list(enumerate(texts)), "pos int, item_json string").withColumns({
        "model_answer": F.lit("A\"\\"), "model_raw": F.lit("R"),
        "model_rationale": F.lit(None).cast("string"), "video_path": F.lit(None).cast("string")})
    got = [r[0] for r in answers.with_answered_json(df).orderBy("pos").select("answered_json").collect()]
    added = {"model_answer": 'A"\\', "model_raw": "R"}
    assert json.loads(got[0]) == {"x": 2} | added
    assert big in got[1] and "1e400" in got[1]
    assert [json.loads(g) for g in got[2:6]] == [
        added, {"a": [1, {"b": "}"}]} | added, {"z": "é"} | added, added]
    assert got[6:] == [None, None]


def test_sinks_count_what_they_write(tmp_path, items):
    done = answered(items)
    assert answers.write_json_lines(done, str(tmp_path / "l")) == 3
    assert answers.write_parquet(done, str(tmp_path / "p")) == 3
    assert answers.write_json_array(done, str(tmp_path / "a")) == 3
