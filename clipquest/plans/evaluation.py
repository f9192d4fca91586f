"""One evaluation: questions and video tables in, answered questions out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.config import EvalConfig
from clipquest.operators import frames as frame_ops
from clipquest.operators.assets import best_assets
from clipquest.operators.frame_index import frame_words
from clipquest.operators.frame_store import Fetch, fetching_backend
from clipquest.operators.inference import (PARSED_COLUMNS, BackendSpec, Dealing, answers,
                                           choose_backend)
from clipquest.operators.items import item_key, valid_items, with_answers
from clipquest.operators.skew import ROWS, SkewPolicy
from clipquest.session import materialize
from clipquest.sources.frames import with_data_urls


@dataclass(frozen=True)
class VideoTables:
    """What is known about the videos; ``videos`` has one row per id.

    ``manifest(id, rel_path, in_subdir, ext)``, ``videos(id, fps,
    total_frames)``, ``frame_index(id, idx)`` and, optionally,
    ``first_frame(id)``. ``words`` may be a stored result of ``frame_words``,
    to reduce the frame index once for many runs.
    """

    manifest: DataFrame
    videos: DataFrame
    frame_index: DataFrame
    first_frame: DataFrame | None = None
    words: DataFrame | None = None


def stored_keys(hinted: DataFrame) -> DataFrame:
    """The distinct plan keys, written once: everything about frames starts from them."""
    return materialize(frame_ops.plan_keys(hinted), "plan-keys")


def frames_of_keys(keys: DataFrame, tables: VideoTables, config: EvalConfig,
                   policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Frames of each plan key; the video tables meet keys and not questions."""
    words = tables.words
    if words is None:
        words = materialize(frame_words(tables.frame_index), "frame-words")
    facts = frame_ops.video_facts(best_assets(tables.manifest, config.videos_dir), tables.videos,
                                  first_frame=tables.first_frame, words=words)
    return frame_ops.select_frames(keys, facts, words, config, policy)


def frame_table(items: DataFrame, tables: VideoTables, config: EvalConfig,
                policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Frames of every distinct (id, hints) among the items, to be stored and reused."""
    keys = stored_keys(frame_ops.with_hints(valid_items(items), config))
    return frames_of_keys(keys, tables, config, policy)


def prepare(items: DataFrame, tables: VideoTables, config: EvalConfig,
            policy: SkewPolicy = SkewPolicy(), spread: tuple[str, ...] | None = None,
            selected: DataFrame | None = None,
            frame_files: DataFrame | None = None) -> DataFrame:
    """Valid items with their video path and frames, ready to be asked.

    The questions are reduced to their plan keys map side and shuffled whole
    only once, to get their frames. Pass ``selected`` to reuse a stored frame
    table, and ``frame_files(path, content)`` to send frames as data URLs; a
    backend that can open the paths itself needs no image bytes in the shuffle.
    ``spread`` tells items apart, by default by their key.
    """
    hinted = frame_ops.with_hints(valid_items(items), config)
    keys = None
    if selected is None:
        keys = stored_keys(hinted)
        selected = frames_of_keys(keys, tables, config, policy)
        if frame_files is not None:
            selected = materialize(selected, "frames")
    if frame_files is not None:
        selected = with_data_urls(selected, frame_files, frame_ops.KEY, config.frames_sent, policy)
    spread = spread or item_key(items)
    return frame_ops.attach_frames(hinted, selected, list(spread), keys, policy).drop("hints")


def evaluate(items: DataFrame, tables: VideoTables,
             backend: Callable | dict[str, BackendSpec], config: EvalConfig,
             policy: SkewPolicy = SkewPolicy(), dealing: Dealing = Dealing(),
             selected: DataFrame | None = None, frame_files: DataFrame | None = None,
             frame_store: Callable[[], Fetch] | None = None, **asking) -> DataFrame:
    """Answer every valid item.

    With a ``frame_store`` (``FolderFrames``, ``PackedFrames`` or the like) rows carry paths, and the workers
    fetch and encode the frames of each call, dealt in the order of their paths; ``frame_files``, a table of contents, sends
    data URLs along with the rows and suits small ones. ``journal`` keeps replies
    from one run to the next.

    ``backend`` makes a model, or is a registry from which the configuration's
    ``backend``, ``model_id``, ``backend_options`` and ``debug`` choose one.
    Model calls cost far more than bytes, so every pass deals its rows out evenly.
    """
    make_backend = choose_backend(config, backend) if isinstance(backend, dict) else backend
    if frame_store is not None:
        make_backend = fetching_backend(make_backend, frame_store)
    dealing = replace(dealing, by=dealing.by or item_key(items),
                      by_frames=dealing.by_frames or frame_store is not None)
    rows = None
    if selected is None:
        keys = stored_keys(frame_ops.with_hints(valid_items(items), config))
        selected = materialize(frames_of_keys(keys, tables, config, policy), "frames")
        rows = keys.agg(F.sum(ROWS)).first()[0] or 0
    prepared = prepare(items, tables, config, policy, dealing.by, selected, frame_files).drop("tier")
    if "urls" in prepared.columns:
        prepared = prepared.drop("frames")
    else:  # of a frame, only its path is asked with
        sent = F.slice("frames", 1, config.frames_sent)
        prepared = prepared.withColumn("frames", F.transform(sent, lambda f: F.struct(f["path"].alias("path"))))
    answered = answers(prepared, make_backend, config, dealing=dealing, rows=rows, **asking)
    parsed = [F.col(f"parsed_{name}") for name in ("answer", "raw", "rationale")]
    shaped = with_answers(answered, *parsed, F.col("video_path"), config.keep_rationale)
    return shaped.drop(*PARSED_COLUMNS, "frames", "frame_error", "urls")
