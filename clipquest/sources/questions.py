"""Question items from JSON arrays, JSON Lines or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquest.operators.items import REQUIRED

ITEM_SCHEMA = "id string, question_type string, question string, answer string"
ITEM_COLUMNS = ["id", "question_type", "question", "answer", "item_json"]
# Texts that a JSON value counting as nothing may have: zero, false, an empty list or object.
NOTHING = r"\A(?:-?0+(?:\.0*)?(?:[eE][+-]?[0-9]+)?|false|\[\s*\]|\{\s*\})\z"
NOT_AN_ARRAY = "not a JSON array"


def explode_items(df: DataFrame, text: Column | str) -> DataFrame:
    """One row per element of a JSON array text, with its position and raw text.

    Elements that are not objects become items without fields. A text that is no
    JSON array gives one such item too, and ``file_error`` says so.
    """
    text = F.col(text) if isinstance(text, str) else text
    rest = [c for c in df.columns]
    listed = df.select(*rest, F.from_json(text, "array<string>").alias("_items"))
    elements = listed.select(*rest, "_items", F.posexplode_outer("_items").alias("pos", "item_json"))
    kept = elements.filter(F.col("_items").isNull() | F.col("pos").isNotNull())
    return parse_items(kept.select(
        *rest, F.coalesce("pos", F.lit(0)).alias("pos"), "item_json",
        F.when(F.col("_items").isNull(), NOT_AN_ARRAY).alias("file_error")))


def parse_items(df: DataFrame, text: str = "item_json") -> DataFrame:
    """Add the item fields of a JSON object text.

    Required values that count as nothing in JSON (0, false, empty lists and
    objects) are left out; their like in quotes stay. Other numbers and truth
    values become text.
    """

    def field(name: str) -> Column:
        value = F.col(f"_item.{name}")
        if name not in REQUIRED:
            return value.alias(name)
        kind = F.schema_of_variant(F.from_json(F.col(text), f"{name} variant")[name])
        return F.when(value.rlike(NOTHING) & (kind != "STRING"), None).otherwise(value).alias(name)

    item = F.from_json(F.col(text), ITEM_SCHEMA)
    return df.withColumn("_item", item).select(
        *df.columns, *map(field, ("id", "question_type", "question", "answer")))


def read_json_array(spark: SparkSession, path: str, on_bad_file: str = "row") -> DataFrame:
    """Items of files that hold one JSON array each, in array order.

    A file is parsed as a whole by one task, so this suits many files of
    moderate size; use JSON Lines or Parquet for a single huge list. A file that
    holds no array becomes one rejected item with its ``source`` and
    ``file_error``, or stops the job with ``on_bad_file="fail"``. Spark's readers
    pass over files of no bytes at all.
    """
    if on_bad_file not in ("row", "fail"):
        raise ValueError(f"on_bad_file must be 'row' or 'fail', not {on_bad_file!r}")
    files = spark.read.text(path, wholetext=True)
    items = explode_items(files.select("value", F.col("_metadata.file_path").alias("source")),
                          "value")
    error = F.col("file_error")
    if on_bad_file == "fail":
        error = F.when(error.isNotNull(), F.raise_error(
            F.concat("source", F.lit(": "), error)).cast("string"))
    return items.select("source", "pos", *ITEM_COLUMNS, error.alias("file_error"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Items of line-delimited JSON files; these split freely.

    ``source``, ``offset`` (where the line's split of the file begins) and
    ``pos`` together put items in the order of the files; ``pos`` alone does not.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("item_json"))
    return parse_items(lines).select("source", "offset", "pos", *ITEM_COLUMNS)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Items from Parquet; only the columns a run uses are read."""
    return spark.read.parquet(path)
