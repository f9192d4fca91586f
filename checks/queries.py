"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.backends import tagged_backend, unreachable_backend
from checks.derived import table
from clipquest.config import EvalConfig
from clipquest.functions import frame_files, frame_times, prompts, replies, timecode
from clipquest.operators import assets as asset_ops
from clipquest.operators import frames as frame_ops
from clipquest.operators import frame_store, inference, items, journal
from clipquest.operators.frame_index import frame_words, readable_prefix
from clipquest.plans import evaluation
from clipquest.session import materialize, scratch_dir, ship_package
from clipquest.sources import answers as answer_sink
from clipquest.sources.assets import assets_from_paths
from clipquest.sources.frames import with_data_urls
from clipquest.sources.json_ranges import read_large_json_array
from clipquest.sources.questions import explode_items, parse_items

VIDEOS_DIR = "videos"
STRICT = EvalConfig.strict(videos_dir=VIDEOS_DIR)
LENIENT = EvalConfig.lenient(videos_dir=VIDEOS_DIR)
REMOTE = EvalConfig.remote(videos_dir=VIDEOS_DIR)

_QUERIES = {}


def query(function):
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict:
    return dict(_QUERIES)


def _hints_text(hints: str = "hints") -> Column:
    return F.array_join(F.transform(hints, lambda h: h.cast("string")), ",")


def _frames_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per frame, and one without a frame for rows that have none."""
    return df.select(*keep, F.posexplode_outer("frames").alias("n", "frame")).select(
        *keep, "n", "frame.t", "frame.idx", "frame.path")


def _message_rows(df: DataFrame, *keep: str) -> DataFrame:
    flat = df.select(*keep, F.posexplode_outer("messages").alias("message_no", "m")).select(
        *keep, "message_no", "m.role", F.posexplode_outer("m.content").alias("part_no", "p"))
    return flat.select(*keep, "message_no", "role", "part_no", "p.type", "p.text",
                       F.array_join("p.refs", "|").alias("refs"))


# Sources and sinks

@query
def json_array_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a JSON array text, two per document; order and unknown keys kept."""
    first = F.struct(F.lit("d").alias("id"), F.lit("Yes/No").alias("question_type"),
                     F.col("text").alias("question"), F.col("lang").alias("answer"),
                     F.col("n_chars").alias("extra"))
    second = F.struct(F.col("source").alias("id"), F.concat("text", F.lit("?")).alias("question"))
    array = F.concat(F.lit("[\n  "), F.to_json(first), F.lit(",\n  "), F.to_json(second),
                     F.lit("\n]"))
    docs = table(spark, sf_dir, "documents").select("doc_id", array.alias("array_text"))
    return explode_items(docs, "array_text").select(
        "doc_id", "pos", "id", "question_type", "question", "answer",
        F.get_json_object("item_json", "$.extra").cast("bigint").alias("extra"))


@query
def large_array_items(spark, sf_dir):
    """Array files of 1,000 document ids each, written by Spark and read back by ranges of 64 KB."""
    docs = table(spark, sf_dir, "documents").withColumn("part", F.floor(F.col("doc_id") / 1000))
    one = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("Yes/No").alias("question_type"),
                             F.col("text").alias("question"), F.array("lang", "source").alias("tags"),
                             F.col("lang").alias("answer")))
    rows = Window.partitionBy("part").orderBy("doc_id", "text")
    placed = docs.withColumn("n", F.row_number().over(rows)).withColumn("after", F.lead("doc_id").over(rows))
    lines = placed.select("part", "n", F.concat(
        F.when(F.col("n") == 1, "[\n").otherwise(""), one,
        F.when(F.col("after").isNull(), "\n]").otherwise(",")).alias("value"))
    path = f"{scratch_dir(spark)}/arrays-{uuid.uuid4().hex}"
    lines.sortWithinPartitions("part", "n").select("part", "value").write.partitionBy("part").text(path)
    found = read_large_json_array(spark, f"{path}/*/*", range_bytes=1 << 16)
    return found.select(
        F.col("id").cast("bigint").alias("doc_id"), "pos", "question_type", "question", "answer",
        F.get_json_object("item_json", "$.tags[1]").alias("second_tag"), "file_error")


@query
def unparseable_items(spark, sf_dir):
    """Texts that hold no JSON array: cut off, a single object, or no JSON at all."""
    whole = F.concat(F.lit("["), F.to_json(F.struct(F.col("text").alias("question"))), F.lit("]"))
    text = (F.when(F.col("doc_id") % 5 == 0, F.left(whole, F.length(whole) - 2))
            .when(F.col("doc_id") % 5 == 1, F.to_json(F.struct("text")))
            .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("no list: "), "text")).otherwise(whole))
    found = explode_items(table(spark, sf_dir, "documents").select("doc_id", text.alias("t")), "t")
    return items.rejected_items(found.filter(F.col("file_error").isNotNull())).select(
        "doc_id", "pos", "missing", "file_error")


@query
def json_line_items(spark, sf_dir):
    """Items of one JSON object per line."""
    source = table(spark, sf_dir, "questions")
    lines = source.select("pos", F.to_json(F.struct(
        "id", "question_type", "question", "answer")).alias("item_json"))
    return parse_items(lines).select("pos", "id", "question_type", "question", "answer")


def _manifest(spark, sf_dir):
    return assets_from_paths(table(spark, sf_dir, "paths"))


@query
def asset_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


def _plain_answers(df: DataFrame) -> DataFrame:
    """Result columns made from the question alone."""
    answer = F.when(F.col("pos") % 3 == 0, "").otherwise(F.upper("question_type"))
    rationale = F.when(F.col("pos") % 4 == 0, "Because of \"quotes\"").otherwise(F.lit(""))
    path = F.when(F.col("pos") % 5 > 0, F.concat(F.lit("videos/"), "id", F.lit(".mp4")))
    return items.with_answers(df, answer, F.col("question"), rationale, path)


@query
def answered_json_items(spark, sf_dir):
    """Items written back as JSON, with a stale answer replaced and extra keys kept."""
    source = items.valid_items(table(spark, sf_dir, "questions"))
    raw = F.to_json(F.struct("id", "question", F.struct(F.col("pos").alias("n")).alias("meta"),
                             F.lit("stale").alias("model_answer"),
                             F.lit("kept").alias("model_rationale")))
    written = answer_sink.with_answered_json(
        _plain_answers(source).withColumn("item_json", raw))

    read_back = F.from_json("answered_json", (
        "id string, question string, meta struct<n: bigint>, model_answer string, "
        "model_raw string, model_rationale string, video_path string"))
    return written.select("pos", read_back.alias("r")).select(
        "pos", "r.id", "r.question", F.col("r.meta.n").alias("meta_n"), "r.model_answer",
        "r.model_raw", "r.model_rationale", "r.video_path")


@query
def written_answers(spark, sf_dir):
    """Per sink: the items that it says it wrote, those read back, and those of them with an answer."""
    rows = materialize(_plain_answers(items.valid_items(table(spark, sf_dir, "questions"))), "answers")
    path = f"{scratch_dir(spark)}/answers-{uuid.uuid4().hex}"
    said = {"json_array": answer_sink.write_json_array(rows, f"{path}/json_array", ("pos",)),
            "json_lines": answer_sink.write_json_lines(rows, f"{path}/json_lines"),
            "parquet": answer_sink.write_parquet(rows, f"{path}/parquet")}

    def texts(sink, value):
        found = F.from_json(value, "id string, model_answer string")
        return spark.read.text(f"{path}/{sink}").select(found.alias("r")).select("r.id", "r.model_answer")

    # An element's line opens with a bracket or comma; the last one ends with a bracket.
    element = F.regexp_replace("value", r"\A[\[,]|\]\z", "")
    read = {"json_array": texts("json_array", element), "json_lines": texts("json_lines", F.col("value")),
            "parquet": spark.read.parquet(f"{path}/parquet").select("id", "model_answer")}
    counts = [found.agg(
        F.lit(sink).alias("sink"), F.lit(said[sink]).cast("bigint").alias("reported"),
        F.count("id").alias("read_back"), F.count_if(F.col("model_answer") != "").alias("answered"))
        for sink, found in read.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def frame_data_urls(spark, sf_dir):
    """Whole texts as file content, under names of several image types."""
    name = F.concat(F.lit("a.b/"), "source", F.element_at(F.array(*map(F.lit, (
        ".jpg", ".PNG", ".gif", ".unknown", ""))), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", frame_files.data_url(
        F.encode("text", "utf-8"), name).alias("data_url"))


@query
def frame_paths(spark, sf_dir):
    """Frame files of every asset, by time, scan index and as a first frame."""
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("id"), "p_retailprice",
        "p_size")
    video = asset_ops.best_assets(_manifest(spark, sf_dir), VIDEOS_DIR)
    path = frame_files.frame_prefix(F.col("video_path"))
    return video.join(part, "id").select(
        "id", frame_files.frame_path(
            path, frame_files.seek_tag(F.col("p_retailprice") / 7)).alias("seek_path"),
        frame_files.frame_path(path, frame_files.scan_tag(F.col("p_size"))).alias("scan_path"),
        frame_files.frame_path(path, F.lit(frame_files.FIRST_FRAME_TAG)).alias("first_path"))


# Items

@query
def valid_items(spark, sf_dir):
    return items.valid_items(table(spark, sf_dir, "questions"))


@query
def rejected_items(spark, sf_dir):
    return items.rejected_items(table(spark, sf_dir, "questions")).select("pos", "missing")


@query
def answer_columns(spark, sf_dir):
    return _plain_answers(items.valid_items(table(spark, sf_dir, "questions")))


@query
def item_counters(spark, sf_dir):
    return items.item_counters(_plain_answers(table(spark, sf_dir, "questions")))


# Timecodes

@query
def timecodes(spark, sf_dir):
    return table(spark, sf_dir, "questions").select(
        "pos", F.posexplode(timecode.extract_timecodes(F.col("question"))).alias("n", "timecode"))


@query
def timecode_seconds(spark, sf_dir):
    question = F.col("question")
    return table(spark, sf_dir, "questions").select(
        "pos", timecode.timecode_seconds(question).alias("hhmm"),
        timecode.timecode_seconds(question, "mmss").alias("mmss"))


@query
def timecode_presence(spark, sf_dir):
    return table(spark, sf_dir, "replies").select(
        "pos", timecode.has_timecode(F.col("reply")).alias("has_timecode"))


@query
def hint_seconds(spark, sf_dir):
    return table(spark, sf_dir, "questions").select(
        "pos", F.posexplode(timecode.hint_seconds(F.col("question"))).alias("n", "seconds"))


# Replies

@query
def transcript_cut(spark, sf_dir):
    """Conversation turns behind an echoed prompt."""
    echoed = F.concat_ws("\n", F.lit("system"), F.lit("be brief"), F.col("role"), F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", replies.cut_transcript(echoed).alias("cut"),
        replies.cut_transcript(F.col("text")).alias("uncut"))


@query
def rationale_split(spark, sf_dir):
    reply = F.col("reply")
    return table(spark, sf_dir, "replies").select(
        "pos", replies.answer_part(reply).alias("answer"),
        replies.rationale_part(reply).alias("rationale"))


def _normalized(spark, sf_dir, question_type: str) -> DataFrame:
    kind, reply = F.lit(question_type), F.col("reply")
    return table(spark, sf_dir, "replies").select(
        "pos", replies.normalize_answer(reply, kind, "strict").alias("strict_answer"),
        replies.normalize_answer(reply, kind, "lenient").alias("lenient_answer"))


@query
def yes_no_answers(spark, sf_dir):
    return _normalized(spark, sf_dir, "Yes/No")


@query
def true_false_answers(spark, sf_dir):
    return _normalized(spark, sf_dir, "True/False")


@query
def timestamp_answers(spark, sf_dir):
    return _normalized(spark, sf_dir, "Timestamp")


@query
def other_answers(spark, sf_dir):
    return _normalized(spark, sf_dir, "Comparative")


def _parsed(df: DataFrame) -> DataFrame:
    return df.select("pos", *inference.PARSED_COLUMNS)


@query
def strict_replies(spark, sf_dir):
    source = table(spark, sf_dir, "replies").withColumn("error", F.lit(None).cast("string"))
    return _parsed(inference.parse_strict(source))


@query
def lenient_replies(spark, sf_dir):
    source = table(spark, sf_dir, "replies").withColumn("error", F.lit(None).cast("string"))
    return _parsed(inference.parse_lenient(source))


# Prompts

@query
def directives(spark, sf_dir):
    return table(spark, sf_dir, "type_names").select(
        "pos", prompts.directive(F.col("question_type")).alias("directive"))


@query
def instructions(spark, sf_dir):
    return table(spark, sf_dir, "type_names").select(
        "pos", prompts.instruction(F.col("question_type")).alias("instruction"))


@query
def answer_types(spark, sf_dir):
    kind = F.col("question_type")
    return table(spark, sf_dir, "type_names").select(
        "pos", prompts.answer_type(kind).alias("answer_type"),
        prompts.answer_guide(kind).alias("guide"))


def _typed(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "type_names").withColumn("id", F.lit("any"))
    return items.valid_items(names).drop("id")


@query
def strict_prompts(spark, sf_dir):
    return _typed(spark, sf_dir).select(
        "pos", prompts.strict_text(F.col("question"), F.col("question_type")).alias("prompt"))


@query
def lenient_prompts(spark, sf_dir):
    kind = F.col("question_type")
    return _typed(spark, sf_dir).select(
        "pos", prompts.lenient_system_text(kind).alias("system_text"),
        prompts.lenient_text(F.col("question"), kind, F.col("frame_count")).alias("user_text"))


def _with_paths(df: DataFrame) -> DataFrame:
    """As many made-up frame paths as the row asks for."""
    numbers = F.sequence(F.lit(1).cast("bigint"), F.col("frame_count"))
    return df.withColumn("frames", F.when(F.col("frame_count") > 0, F.transform(
        numbers, lambda i: F.struct(
            i.cast("double").alias("t"), i.alias("idx"),
            F.concat(F.lit("f"), i.cast("string")).alias("path")))).otherwise(
                F.array().cast(frame_ops.FRAMES_TYPE)))


def _messages(spark, sf_dir, config: EvalConfig) -> DataFrame:
    rows = _with_paths(_typed(spark, sf_dir))
    return _message_rows(rows.select(
        "pos", inference.messages_for(config, F.col("frames.path")).alias("messages")), "pos")


@query
def video_messages(spark, sf_dir):
    return _messages(spark, sf_dir, STRICT)


@query
def image_messages(spark, sf_dir):
    return _messages(spark, sf_dir, LENIENT)


@query
def remote_messages(spark, sf_dir):
    return _messages(spark, sf_dir, REMOTE)


@query
def bare_messages(spark, sf_dir):
    return _message_rows(_typed(spark, sf_dir).select("pos", prompts.bare_messages(
        F.col("question"), F.col("question_type")).alias("messages")), "pos")


# Frame plans

@query
def video_durations(spark, sf_dir):
    fps, total = F.col("fps"), F.col("total_frames")
    return table(spark, sf_dir, "videos").select(
        "id", frame_times.effective_fps(fps).alias("fps"),
        frame_times.duration(total, fps).alias("duration"),
        frame_times.last_time(total, fps).alias("last_time"))


@query
def rounded_times(spark, sf_dir):
    """Exact rounding on prices and on products that sit on decimal ties."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        frame_times.round_half_even_2(price * 0.15).alias("part_of_price"),
        frame_times.round_half_even_2(quantity * 0.005).alias("on_tie"),
        frame_times.round_half_even_2(quantity / 8.0).alias("on_exact_tie"))


@query
def clamped_times(spark, sf_dir):
    rows = table(spark, sf_dir, "questions").select(
        "pos", F.explode(timecode.hint_seconds(F.col("question"))).alias("hint"))
    end = F.lit(90.5)
    return rows.select("pos", "hint", *[
        frame_times.clamp(F.col("hint") + d, F.lit(0.0), end).alias(name)
        for d, name in ((-2.0, "before"), (0.0, "at"), (2.0, "after"))])


def _document_plan(spark, sf_dir, config: EvalConfig, frames: Column) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(25.0).alias("fps"), frames.alias("total_frames"),
        F.array().cast("array<bigint>").alias("hints"))
    return (frame_ops.with_frame_times(docs, config)
            .select("doc_id", "fps", F.posexplode_outer("times").alias("n", "t"))
            .select("doc_id", "n", "t",
                    frame_times.frame_number(F.col("t"), F.col("fps")).alias("idx")))


@query
def even_frame_plan(spark, sf_dir):
    return _document_plan(spark, sf_dir, STRICT, F.col("n_chars"))


@query
def thinned_frame_plan(spark, sf_dir):
    """More times than frames allowed, on the exact middle of each interval."""
    config = EvalConfig.lenient(frames_per_question=61)
    return _document_plan(spark, sf_dir, config, F.col("n_chars"))


@query
def hinted_frame_plan(spark, sf_dir):
    """Plans of the questions on a video as long as the event's value in seconds."""
    rows = frame_ops.with_hints(
        table(spark, sf_dir, "questions").drop("answer"), LENIENT
    ).join(table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), F.lit(29.97).alias("fps"),
        (F.col("value") * 25).cast("bigint").alias("total_frames")), "pos")
    planned = frame_ops.with_frame_times(rows.filter(F.size("hints") > 0), LENIENT)
    return (planned.select("pos", "fps", F.posexplode_outer("times").alias("n", "t"))
            .select("pos", "n", "t",
                    frame_times.frame_number(F.col("t"), F.col("fps")).alias("idx")))


@query
def scan_plan(spark, sf_dir):
    """Frames of a linear scan over every document, all of it readable."""
    want = frame_times.scan_count(STRICT.frames_per_question, STRICT.max_frames)
    size = F.col("n_chars")
    return (table(spark, sf_dir, "documents")
            .select("doc_id", F.posexplode(frame_times.scan_numbers(size, size, want))
                    .alias("n", "idx"))
            .select("doc_id", "n", "idx", frame_times.scan_time(
                F.col("idx"), F.lit(12.5)).alias("t")))


@query
def capped_frames(spark, sf_dir):
    """How many frames each kind of model gets, and the last of them."""
    rows = _with_paths(table(spark, sf_dir, "type_names").withColumn(
        "frame_count", F.col("frame_count") + 2))
    out = rows.select("pos", *[
        frame_times.first_frames(F.col("frames.path"), c.frames_sent).alias(name)
        for c, name in ((STRICT, "strict"), (LENIENT, "lenient"), (REMOTE, "remote"))])
    return out.select("pos", *[x for name in ("strict", "lenient", "remote") for x in (
        F.size(name).alias(f"{name}_count"),
        F.element_at(name, -1).alias(f"{name}_last"))])


# Assets, plan keys and frames

@query
def best_assets(spark, sf_dir):
    return asset_ops.best_assets(_manifest(spark, sf_dir), VIDEOS_DIR)


@query
def resolved_videos(spark, sf_dir):
    valid = items.valid_items(table(spark, sf_dir, "questions"))
    found = asset_ops.best_assets(_manifest(spark, sf_dir), VIDEOS_DIR)
    return asset_ops.resolve_videos(valid, found, ["pos"]).select("pos", "id", "video_path")


def _keys(spark, sf_dir, config: EvalConfig = STRICT) -> DataFrame:
    valid = items.valid_items(table(spark, sf_dir, "questions"))
    return frame_ops.plan_keys(frame_ops.with_hints(valid, config))


@query
def plan_keys(spark, sf_dir):
    return _keys(spark, sf_dir).select("id", _hints_text().alias("hints"),
                                       F.col("_rows").alias("questions"))


@query
def readable_prefixes(spark, sf_dir):
    words = materialize(frame_words(table(spark, sf_dir, "frame_index")), "frame-words")
    return readable_prefix(words)


def _tables(spark, sf_dir) -> evaluation.VideoTables:
    return evaluation.VideoTables(
        _manifest(spark, sf_dir), table(spark, sf_dir, "videos"),
        table(spark, sf_dir, "frame_index"), table(spark, sf_dir, "first_frame"))


def _selected(spark, sf_dir, config: EvalConfig = STRICT) -> DataFrame:
    return evaluation.frame_table(table(spark, sf_dir, "questions"), _tables(spark, sf_dir),
                                  config)


def _tier(spark, sf_dir, tier: int) -> DataFrame:
    chosen = _selected(spark, sf_dir).filter(F.col("tier") == tier)
    return _frames_rows(chosen.withColumn("hints", _hints_text()), "id", "hints")


@query
def sought_frames(spark, sf_dir):
    return _tier(spark, sf_dir, frame_ops.SEEK)


@query
def scanned_frames(spark, sf_dir):
    return _tier(spark, sf_dir, frame_ops.SCAN)


@query
def grabbed_frames(spark, sf_dir):
    return _tier(spark, sf_dir, frame_ops.FIRST_FRAME)


@query
def selected_frames(spark, sf_dir):
    """Frames of every plan key, whatever their source."""
    rows = _selected(spark, sf_dir).withColumn("hints", _hints_text())
    return _frames_rows(rows, "id", "hints", "video_path", "tier", "frame_error")


@query
def unopenable_videos(spark, sf_dir):
    return (_selected(spark, sf_dir).filter(F.col("frame_error").isNotNull())
            .select("id", _hints_text().alias("hints"), "frame_error"))


def _frame_files(selected: DataFrame) -> DataFrame:
    """A file for each frame of these plans, but for every eleventh frame number."""
    paths = selected.select(F.explode("frames").alias("f")).filter("f.idx % 11 <> 7").select("f.path")
    return paths.distinct().withColumn("content", F.encode("path", "utf-8"))


@query
def missing_frame_files(spark, sf_dir):
    """Plans with the number of their data URLs, and the first file that is not there."""
    chosen = materialize(_selected(spark, sf_dir, REMOTE), "frames")
    found = with_data_urls(chosen, _frame_files(chosen), frame_ops.KEY, REMOTE.frames_sent)
    return found.select("id", _hints_text().alias("hints"), F.size("urls").alias("urls"), "frame_error")


@query
def question_frames(spark, sf_dir):
    """The frames of each question, one row per frame."""
    prepared = evaluation.prepare(table(spark, sf_dir, "questions"), _tables(spark, sf_dir), STRICT)
    return _frames_rows(prepared, "pos", "id", "video_path", "tier")


# Models

def _scratch(spark, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_dir(spark)}/clipquest/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _askable(spark, sf_dir) -> DataFrame:
    ship_package(spark, Path(__file__).parent)
    asked = items.valid_items(table(spark, sf_dir, "questions"))
    # Spread while rows are narrow: few large splits would deal out all their rows' frames from one task.
    asked = inference.Dealing(rows_per_task=100_000).deal(asked)
    return _with_paths(asked.withColumn("frame_count", F.col("pos") % 23)).withColumn(
        "frame_error", F.when(F.col("pos") % 29 == 0, "RuntimeError: Cannot open video: x")
    ).drop("frame_count")


def _answered(df: DataFrame) -> DataFrame:
    return df.select("pos", *inference.PARSED_COLUMNS)


@query
def strict_model_answers(spark, sf_dir):
    return _answered(inference.answers(_askable(spark, sf_dir), tagged_backend, STRICT))


@query
def journaled_model_answers(spark, sf_dir):
    """Each distinct request asked once into a journal, and all answers read from it by a second run."""
    log = journal.Journal(_scratch(spark, "journal"), shared=True, rows_per_wave=20_000)
    asked = _askable(spark, sf_dir)
    inference.answers(asked, tagged_backend, STRICT, journal=log)
    return _answered(inference.answers(asked, unreachable_backend, STRICT, journal=log))


@query
def lenient_model_answers(spark, sf_dir):
    return _answered(inference.answers(_askable(spark, sf_dir), tagged_backend, LENIENT))


@query
def remote_model_answers(spark, sf_dir):
    return _answered(inference.answers(_askable(spark, sf_dir), tagged_backend, REMOTE))


# The backends that a configuration may name.
BACKENDS = {name: inference.BackendSpec(lambda options: tagged_backend) for name in ("local", "remote")}


def _evaluated(spark, sf_dir, config: EvalConfig, **frames) -> DataFrame:
    ship_package(spark, Path(__file__).parent)
    done = evaluation.evaluate(table(spark, sf_dir, "questions"), _tables(spark, sf_dir), BACKENDS,
                               config, **frames)
    return done.select("pos", "id", "question_type", "question", "answer", "model_answer",
                       "model_raw", "model_rationale", "video_path")


@query
def strict_evaluation(spark, sf_dir):
    """Everything together, strict rules."""
    return _evaluated(spark, sf_dir, STRICT)


@query
def lenient_evaluation(spark, sf_dir):
    """Everything together, lenient rules."""
    return _evaluated(spark, sf_dir, LENIENT)


@query
def remote_evaluation(spark, sf_dir):
    """Everything together; workers fetch packed frames and send data URLs; some files are missing."""
    chosen = materialize(_selected(spark, sf_dir, REMOTE), "frames")
    packed = frame_store.pack_frames(_frame_files(chosen), _scratch(spark, "packed"), buckets=16)
    return _evaluated(spark, sf_dir, REMOTE, selected=chosen, frame_store=packed)
