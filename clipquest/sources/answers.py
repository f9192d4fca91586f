"""Answered items as JSON or Parquet."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clipquest.operators.items import item_key

RESULT_KEYS = ("model_answer", "model_raw", "model_rationale", "video_path")
_MAP = "map<string, variant>"


def answered_json(item_json: Column, keys: tuple[str, ...] = RESULT_KEYS) -> Column:
    """The input item with the result keys set.

    The keys are put in before the closing brace, so everything else stays as it
    is written. A result column that is NULL leaves the item as it is; one that is
    not replaces a key of its name. For that, items that already hold such a key
    are parsed and written anew. In an item with a repeated key the last value
    holds, as in most parsers, and the result keys come last.
    """
    item = F.rtrim(item_json, F.lit(" \t\r\n"))
    names = F.json_object_keys(item_json)
    present = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys]))
    body = F.substr(F.to_json(F.struct(*keys)), F.lit(2))
    spliced = F.concat(F.left(item, F.length(item) - 1), F.when(F.size(names) > 0, ",").otherwise(""), body)
    unique = F.size(names) == F.size(F.array_distinct(names))
    return (F.when(names.isNull(), None)
            .when(F.size(present) == 0, item_json)
            .when(unique & F.arrays_overlap(names, present), _written_anew(item_json, keys))
            .otherwise(spliced))


def _written_anew(item_json: Column, keys: tuple[str, ...]) -> Column:
    """The same through a map of values, without the keys that are replaced."""
    entries = [x for k in keys for x in (F.lit(k), F.col(k).cast("variant"))]
    added = F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())

    def is_replaced(name: Column) -> Column:
        return reduce(or_, [(name == k) & F.col(k).isNotNull() for k in keys])

    kept = F.map_filter(F.from_json(item_json, _MAP), lambda name, _: ~is_replaced(name))
    return F.to_json(F.map_concat(kept, added))


def with_answered_json(results: DataFrame) -> DataFrame:
    """Add ``answered_json``, from the raw item where there is one."""
    if "item_json" in results.columns:
        return results.withColumn("answered_json", answered_json(F.col("item_json")))
    fields = [c for c in ("id", "question_type", "question", "answer") if c in results.columns]
    return results.withColumn("answered_json", F.to_json(F.struct(*fields, *RESULT_KEYS)))


def _counted(rows: DataFrame, write) -> int:
    """Write the rows and count them on the way."""
    written = Observation()
    write(rows.observe(written, F.count(F.lit(1)).alias("rows")))
    return written.get["rows"]


def write_json_lines(results: DataFrame, path: str) -> int:
    """One answered item per line, in as many files as there are partitions; how many."""
    lines = with_answered_json(results).select(F.col("answered_json").alias("value"))
    return _counted(lines, lambda rows: rows.write.text(path))


def write_parquet(results: DataFrame, path: str) -> int:
    return _counted(results, lambda rows: rows.write.parquet(path))


def write_json_array(results: DataFrame, path: str, order: tuple[str, ...] | None = None) -> int:
    """Text parts that, put one after another by name, are one JSON array; how many items.

    The rows are range-partitioned by ``order``, by default the items' key, so no
    task sees the whole array. Rows that repeat it are refused before anything is
    written. Every element but the first opens with a comma; the brackets go to
    the first and the last row. ``results`` are read more than once, so pass a
    stored table.
    """
    order = tuple(order or item_key(results))
    rows = with_answered_json(results).select(*order, "answered_json")
    key = F.struct(*order)
    repeated = results.groupBy(*order).count().filter("count > 1").first()
    if repeated is not None:
        raise ValueError(f"{repeated['count']} rows have the key {tuple(repeated)[:-1]}")
    ends = results.agg(F.min(key).alias("first"), F.max(key).alias("last")).first()
    if ends["first"] is None:
        results.sparkSession.createDataFrame([("[]",)], "value string").write.text(path)
        return 0

    def at(end) -> Column:
        same = F.lit(True)
        for name in order:
            same = same & (F.col(name) == F.lit(end[name]))
        return same

    line = F.concat(F.when(at(ends["first"]), "[").otherwise(","), "answered_json",
                    F.when(at(ends["last"]), "]").otherwise(""))
    lines = rows.orderBy(*order).select(line.alias("value"))
    return _counted(lines, lambda rows: rows.write.text(path))
