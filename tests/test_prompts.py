import pytest
from pyspark.sql import functions as F

from clipquest.config import EvalConfig
from clipquest.functions import prompts
from clipquest.operators.inference import messages_for


@pytest.mark.parametrize("kind, expected", [
    ("Yes/No", "yes_no"), (" Yes/No ", "yes_no"), ("True/False", "yes_no"),
    ("Timestamp", "timestamp"), ("A Multiple Choice Question here", "mcq_option"),
    ("MCQ", "mcq_option"), ("Hypothetical", "free_text"), ("Comparative", "free_text"),
    ("anything", "free_text"), (None, "free_text"), ("Temporal continuity", "yes_no"),
    ("Identity Confirmation (Validation, Yes/No)", "yes_no"),
])
def test_answer_types(spark, kind, expected):
    assert spark.range(1).select(
        prompts.answer_type(F.lit(kind).cast("string"))).first()[0] == expected


def test_hypothetical_is_yes_no_in_the_strict_prompt_only(spark):
    row = spark.range(1).select(prompts.instruction(F.lit("Hypothetical")),
                                prompts.instruction(F.lit(" Yes/No ")),
                                prompts.directive(F.lit("Hypothetical"))).first()
    assert tuple(row) == (prompts.YES_NO_INSTRUCTION, prompts.DEFAULT_INSTRUCTION,
                          "Answer concisely.")


def messages(spark, config, frames, kind="Yes/No"):
    df = spark.createDataFrame([("Same person?", kind, frames)],
                               "question string, question_type string, frames array<string>")
    return df.select(messages_for(config, F.col("frames"))).first()[0]


def test_strict_messages(spark):
    paths = [f"f{i}" for i in range(20)]
    (user,) = messages(spark, EvalConfig.strict(), paths)
    video, text = user["content"]
    assert (video["type"], video["refs"], text["type"]) == ("video", paths[:16], "text")
    assert text["text"] == (
        "Same person?\n\nConstraints: Answer strictly Yes or No.\n\nConstraints: "
        + prompts.YES_NO_INSTRUCTION)
    (user,) = messages(spark, EvalConfig.strict(), [])
    assert [p["type"] for p in user["content"]] == ["text"]


def test_lenient_messages(spark):
    paths = [f"f{i}" for i in range(20)]
    system, user = messages(spark, EvalConfig.lenient(), paths, "Timestamp")
    assert 'here it is "timestamp"' in system["content"][0]["text"]
    assert "Frames shown: 12\n" in user["content"][0]["text"]
    assert [(p["type"], p["refs"]) for p in user["content"][1:]] == [("image", [p]) for p in paths[:12]]


def test_remote_messages(spark):
    paths = [f"f{i}" for i in range(25)]
    _, user = messages(spark, EvalConfig.remote(), paths, "Other")
    assert user["content"][0]["text"] == "Same person?\n\nConstraints: Answer concisely."
    assert [p["type"] for p in user["content"][1:]] == ["input_image"] * 20


def test_small_frame_limits_lower_the_caps():
    assert EvalConfig.strict(max_frames=4).frames_sent == 4
    assert EvalConfig.lenient(max_frames=4).frames_sent == 4
    assert EvalConfig.remote(max_frames=4).frames_sent == 20


@pytest.mark.parametrize("bad", [
    {"max_frames": 0}, {"two_field": "ssmm"}, {"on_bad_video": "skip"}, {"mode": "loose"},
    {"chat": "audio"}])
def test_bad_settings_are_refused(bad):
    with pytest.raises(ValueError):
        EvalConfig.strict(**bad)
