"""Arriving JSON Lines files of questions, answered batch by batch.

Parsing is stateless; joins and model calls run inside ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clipquest.sources.questions import ITEM_COLUMNS, parse_items


def read_question_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Items of JSON Lines files that appear under ``path``.

    ``pos`` orders the items of a batch only as far as their files do.
    """
    lines = (spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
             .select(F.col("_metadata.file_path").alias("source"),
                     F.xxhash64("_metadata.file_path", "value").alias("pos"),
                     F.col("value").alias("item_json")))
    return parse_items(lines).select("source", "pos", *ITEM_COLUMNS)


def answer_stream(items: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str,
                  checkpoint: str, **trigger) -> StreamingQuery:
    """Write ``answer(batch)`` of every batch to a folder of its own under ``out``.

    A batch that is run again after a failure replaces its own folder, so no
    answer is written twice. Give ``answer`` stored frame words
    (``VideoTables.words``), or every batch reduces the whole frame index anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
