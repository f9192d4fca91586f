"""Arrays read by byte ranges give what parsing whole files gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from clipquest.sources import json_ranges
from clipquest.sources.questions import NOT_AN_ARRAY, read_json_array

COLUMNS = ["source", "pos", "id", "question_type", "question", "answer", "item_json", "file_error"]


def rows_of(df):
    found = df.withColumn("source", F.regexp_extract("source", r"([^/]+)\z", 1)).select(*COLUMNS)
    return sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[1]))


def odd_value(pick, depth=0):
    kind = pick.randrange(8 if depth < 4 else 5)
    text = "".join(pick.choice('",\\[]{}: \n\tab日é ') for _ in range(pick.randrange(12)))
    if kind < 2:
        return text
    if kind < 5:
        return [None, True, -1.5, 12][pick.randrange(4)]
    if kind < 7:
        return {f"{text}{i}": odd_value(pick, depth + 1) for i in range(pick.randrange(4))}
    return [odd_value(pick, depth + 1) for _ in range(pick.randrange(4))]


def odd_items(seed, count):
    pick = random.Random(seed)
    return [{"id": f"v{i}", "question": odd_value(pick), "question_type": "Yes/No", "more": odd_value(pick)}
            if pick.random() < 0.8 else odd_value(pick) for i in range(count)]


@pytest.mark.parametrize("size", [1, 3, 64, 1 << 20])
def test_ranges_of_any_size_equal_whole_files(spark, tmp_path, size):
    few = size < 7
    for seed in range(2 if few else 6):
        items = odd_items(seed, 3 if few else 30)
        (tmp_path / f"{seed}.json").write_text(json.dumps(
            items, ensure_ascii=seed % 2 == 0, indent=[None, 2, "\t"][seed % 3]), encoding="utf-8")
    (tmp_path / "empty.json").write_text(" [ \n ] ")
    (tmp_path / "one.json").write_text(' ["a\\\\\\"],[\\\\"]\n')
    (tmp_path / "lists.json").write_text("[[1,[2]],[],[[]]]")
    want = rows_of(read_json_array(spark, str(tmp_path)))
    assert len(want) > 5
    assert rows_of(json_ranges.read_large_json_array(spark, str(tmp_path), size)) == want


def test_files_that_are_no_lists(spark, tmp_path):
    texts = {"cut": '[{"id": "a"}, {"id"', "object": '{"a": 1, "b": [2]}', "words": "no list, really",
             "open": '["a, b]', "blank": " \n\t ", "deep": '[[1, 2]'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "nothing").write_text("")
    for size in (4, 1 << 20):
        found = rows_of(json_ranges.read_large_json_array(spark, str(tmp_path), size))
        assert [(r[0], r[1], r[-2], r[-1]) for r in found] == [(n, 0, None, NOT_AN_ARRAY) for n in sorted(texts)]
        assert found == rows_of(read_json_array(spark, str(tmp_path)))


def test_bad_elements_are_rejected_at_their_places(spark, tmp_path):
    (tmp_path / "a b%20.json").write_text('[{"id": "x"}, nope, , {"id": "y"}, {1}, 5,]')
    found = rows_of(json_ranges.read_large_json_array(spark, str(tmp_path), 5))
    assert [(r[1], r[2], r[-1]) for r in found] == [
        (0, "x", None), (1, None, json_ranges.NOT_JSON), (2, None, json_ranges.NOT_JSON), (3, "y", None),
        (4, None, json_ranges.NOT_JSON), (5, None, None), (6, None, json_ranges.NOT_JSON)]


def test_long_elements_and_many_blocks_of_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_ranges, "_BLOCK", 3)
    items = [{"id": str(i), "question": "q" * (5000 if i % 10 == 3 else i)} for i in range(60)]
    items[7]["question"] = "\\" * 3001 + '"'
    (tmp_path / "long.json").write_text(json.dumps(items))
    found = rows_of(json_ranges.read_large_json_array(spark, str(tmp_path), 100))
    assert found == rows_of(read_json_array(spark, str(tmp_path)))
    assert [r[1] for r in found] == list(range(60))


def test_texts_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(odd_items(1, 20)))
    plan = json_ranges.read_large_json_array(spark, str(tmp_path), 64)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "element" not in line and "item_json" not in line
    with pytest.raises(ValueError):
        json_ranges.read_large_json_array(spark, str(tmp_path), 0)
