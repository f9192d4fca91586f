"""Prompt texts and chat messages per question type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipquest.functions.text import strip

# The short directive after each question.
DIRECTIVES = {
    "Yes/No": "Answer strictly Yes or No.",
    "True/False": "Answer strictly True or False.",
    "Timestamp": "Answer strictly with a timestamp in HH:MM:SS.",
}
DEFAULT_DIRECTIVE = "Answer concisely."

# The longer instruction of the strict prompt.
YES_NO_INSTRUCTION = "Answer strictly with Yes or No. If unsure, guess the most likely. Then add one short sentence rationale starting with 'Because'."
TRUE_FALSE_INSTRUCTION = "Answer strictly with True or False. If unsure, guess the most likely. Then add one short sentence rationale starting with 'Because'."
TIMESTAMP_INSTRUCTION = "Answer strictly with a timestamp in HH:MM:SS. If no clear answer, return the most plausible timestamp in HH:MM:SS. Then add one short sentence rationale starting with 'Because'."
OPTION_INSTRUCTION = "Answer strictly with the letter of the correct option (e.g., A, B, C, or D). Then add one short sentence rationale starting with 'Because'."
DEFAULT_INSTRUCTION = "Answer concisely. Then add one short sentence rationale starting with 'Because'."
INSTRUCTIONS = {
    "Multiple Choice Question (MCQ)": OPTION_INSTRUCTION,
    "Identity Confirmation (Validation)": YES_NO_INSTRUCTION,
    "Identity Confirmation": YES_NO_INSTRUCTION,
    "Hypothetical": YES_NO_INSTRUCTION,
    "Yes/No": YES_NO_INSTRUCTION,
    "True/False": TRUE_FALSE_INSTRUCTION,
    "Timestamp": TIMESTAMP_INSTRUCTION,
}

# Question types by kind of answer in the lenient prompt.
YES_NO_TYPES = (
    "Yes/No",
    "Identity Confirmation",
    "Identity Confirmation (Validation)",
    "Identity Confirmation (Validation, Yes/No)",
    "Clothing-change tracking",
    "Temporal continuity",
    "Cross-view matching",
    "Temporal-appearance drift",
)
FREE_TEXT_TYPES = (
    "Descriptive Identification",
    "Activity-based",
    "Interaction-based",
    "Group-context based",
    "Environment-linked",
    "Comparative",
    "Hypothetical",
    "Cross-modal",
)
OPTION_WORDS = ("Multiple Choice Question", "MCQ")

MESSAGES_TYPE = ("array<struct<role: string, content: array<"
                 "struct<type: string, text: string, refs: array<string>>>>>")


@dataclass(frozen=True)
class PromptTexts:
    """Wording of the lenient and remote prompts; replace it to tune a model.

    ``{answer_type}`` and ``{guide}`` are filled per question.
    """

    system: str = (
        "You answer questions about people and objects in a video, from key frames only. "
        "Keep identities consistent from frame to frame. Times named in a question tell "
        "where its frames were taken.\n\n"
        "Reply with exactly one JSON object that has two keys, \"answer\" and "
        "\"answer_type\", and with nothing before or after it.\n"
        "\"answer_type\" is \"yes_no\", \"mcq_option\", \"timestamp\" or \"free_text\"; "
        "here it is \"{answer_type}\".\n"
        "{guide}\n"
        "Give no reasons and no markdown."
    )
    closing: str = "Use only what the frames show and keep to the JSON rules above."
    remote_system: str = (
        "Task: answer one question about a clip that is shown as stills in time order; a time "
        "in the question marks the part they were taken from.\n"
        "Evidence: nothing but the stills, in which a person or thing stays the same one "
        "throughout.\n"
        "Form: the answer in the shape asked for, then a single sentence that opens with "
        "'Because' and names what settles it."
    )
    yes_no: str = "\"answer\" is exactly \"Yes\" or \"No\"."
    true_false: str = "\"answer\" is exactly \"True\" or \"False\"."
    timestamp: str = "\"answer\" is one zero-padded time, \"MM:SS\" or \"HH:MM:SS\"."
    option: str = "\"answer\" is the letter of the best option, without its text."
    described: str = "\"answer\" is a short phrase or sentence without further comment."
    free_text: str = "\"answer\" is a short phrase or sentence that does not repeat the question."


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.lit(default))


def directive(question_type: Column) -> Column:
    """Short directive per type."""
    return _lookup(question_type, DIRECTIVES, DEFAULT_DIRECTIVE)


def instruction(question_type: Column) -> Column:
    """Strict instruction per type."""
    return _lookup(question_type, INSTRUCTIONS, DEFAULT_INSTRUCTION)


def _by_kind(question_type: Column, yes_no, true_false, timestamp, option, described, other):
    kind = strip(F.coalesce(question_type, F.lit("")))
    has_option = F.contains(kind, F.lit(OPTION_WORDS[0])) | F.contains(kind, F.lit(OPTION_WORDS[1]))
    return (F.when(kind.isin(*FREE_TEXT_TYPES), described)
            .when(has_option, option)
            .when(kind == "Timestamp", timestamp)
            .when(kind == "True/False", true_false)
            .when(kind.isin(*YES_NO_TYPES), yes_no)
            .otherwise(other))


def answer_type(question_type: Column) -> Column:
    """Kind of answer the lenient prompt asks for."""
    return _by_kind(question_type, "yes_no", "yes_no", "timestamp", "mcq_option",
                    "free_text", "free_text")


def answer_guide(question_type: Column, texts: PromptTexts = PromptTexts()) -> Column:
    """Rules for the content of the answer in the lenient prompt."""
    return _by_kind(question_type, texts.yes_no, texts.true_false, texts.timestamp,
                    texts.option, texts.described, texts.free_text)


def constrained(text: Column, constraint: Column) -> Column:
    return F.concat(text, F.lit("\n\nConstraints: "), constraint)


def directed_question(question: Column, question_type: Column) -> Column:
    """Question with its directive; every preset starts from this."""
    return constrained(question, directive(question_type))


def strict_text(question: Column, question_type: Column) -> Column:
    """User text of the strict prompt: directive and instruction both."""
    return constrained(directed_question(question, question_type), instruction(question_type))


def lenient_system_text(question_type: Column, texts: PromptTexts = PromptTexts()) -> Column:
    """System text with the rules for this type."""
    kind, guide = answer_type(question_type), answer_guide(question_type, texts)
    filled = F.replace(F.lit(texts.system), F.lit("{answer_type}"), kind)
    return F.replace(filled, F.lit("{guide}"), guide)


def lenient_text(question: Column, question_type: Column, frame_count: Column,
                 texts: PromptTexts = PromptTexts()) -> Column:
    """User text of the lenient prompt."""
    return F.concat(
        F.lit("Kind of question: "), question_type,
        F.lit("\nFrames shown: "), frame_count.cast("string"),
        F.lit("\n\nQuestion: "), directed_question(question, question_type),
        F.lit("\n\n"), F.lit(texts.closing))


def _part(kind: str, text: Column | None = None, refs: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        (F.lit(None).cast("string") if text is None else text).alias("text"),
        (F.lit(None).cast("array<string>") if refs is None else refs).alias("refs"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _image_parts(kind: str, frames: Column) -> Column:
    return F.transform(frames, lambda f: _part(kind, refs=F.array(f)))


def video_messages(question: Column, question_type: Column, frames: Column) -> Column:
    """Strict chat: one video part with all frames, then the text."""
    text = F.array(_part("text", strict_text(question, question_type)))
    video = F.array(_part("video", refs=frames))
    content = F.when(F.size(frames) > 0, F.concat(video, text)).otherwise(text)
    return F.array(_message("user", content)).cast(MESSAGES_TYPE)


def bare_messages(question: Column, question_type: Column) -> Column:
    """Strict chat after a preprocessing failure: no frames, no instruction."""
    text = _part("text", directed_question(question, question_type))
    return F.array(_message("user", F.array(text))).cast(MESSAGES_TYPE)


def image_messages(question: Column, question_type: Column, frames: Column,
                   texts: PromptTexts = PromptTexts()) -> Column:
    """Lenient chat: system rules, then the text and one image part per frame."""
    system = F.array(_part("text", lenient_system_text(question_type, texts)))
    text = F.array(_part("text", lenient_text(question, question_type, F.size(frames), texts)))
    user = F.concat(text, _image_parts("image", frames))
    return F.array(_message("system", system), _message("user", user)).cast(MESSAGES_TYPE)


def remote_messages(question: Column, question_type: Column, frames: Column,
                    texts: PromptTexts = PromptTexts()) -> Column:
    """Remote chat: fixed system text, then the question and its images."""
    system = F.array(_part("text", F.lit(texts.remote_system)))
    text = F.array(_part("text", directed_question(question, question_type)))
    user = F.concat(text, _image_parts("input_image", frames))
    return F.array(_message("system", system), _message("user", user)).cast(MESSAGES_TYPE)
