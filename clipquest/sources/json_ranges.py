"""Items of JSON arrays of any size: the byte ranges of a file are read in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipquest.session import materialize, ship_package
from clipquest.sources.questions import ITEM_COLUMNS, NOT_AN_ARRAY, parse_items

NOT_JSON = "not a JSON value"
RANGE_BYTES = 4 << 20
# Ranges whose prefix sums one task works out together.
_BLOCK = 1024
_LOOK_BACK = 256
# First bytes read beyond a range for the rest of its last element; each read after it doubles.
_READ_ON = 1 << 13


def open_file(path: str):
    """A file that can be read at any place; ``path`` as Spark's binary file reader names it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    scheme, _, rest = path.partition("://")
    files, _ = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{rest.split('/')[0]}/")
    place = rest if scheme in ("s3", "s3a", "gs") else "/" + rest.partition("/")[2]
    return files.open_input_file(place)


def by_file(batch: pa.RecordBatch) -> Iterator[tuple]:
    """An open file and a row, for every row of ``batch``; each file is opened once."""
    rows = sorted(batch.to_pylist(), key=lambda r: (r["path"], r["start"]))
    for path, ranges in groupby(rows, key=lambda r: r["path"]):
        with open_file(path) as file:
            for row in ranges:
                yield file, row


def is_escaped(file, start: int) -> bool:
    """Whether an odd run of backslashes ends right before ``start``."""
    run, end = 0, start
    while end > 0:
        low = max(0, end - _LOOK_BACK)
        data = file.read_at(end - low, low)
        kept = data.rstrip(b"\\")
        run += len(data) - len(kept)
        if kept:
            break
        end = low
    return run % 2 == 1


def structure(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: quotes so far that open or close strings, and the byte's kind.

    Kinds: 1 opens a list or object, -1 closes one, 2 is a comma, 0 is anything else.
    """
    codes = np.frombuffer(data, np.uint8)
    quote = codes == 0x22
    slashes = np.flatnonzero(codes == 0x5C)
    if len(slashes):
        new = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        first, last = slashes[new], slashes[np.append(new[1:], len(slashes)) - 1]
        length = last - first + 1
        if escaped and first[0] == 0:
            length[0] -= 1
        after = last[length % 2 == 1] + 1
        quote[after[after < len(codes)]] = False
    if escaped and len(codes):
        quote[0] = False
    kind = np.zeros(len(codes), np.int8)
    kind[(codes == 0x5B) | (codes == 0x7B)] = 1
    kind[(codes == 0x5D) | (codes == 0x7D)] = -1
    kind[codes == 0x2C] = 2
    return np.cumsum(quote, dtype=np.int32), kind


def commas(quotes: np.ndarray, kind: np.ndarray, inside: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The change of depth, the commas outside strings, and their depths against the start's.

    ``inside`` is 1 if the bytes begin within a string.
    """
    outside = (quotes + inside) & 1 == 0
    steps = np.where(outside & (kind != 2), kind, 0)
    depth = np.cumsum(steps, dtype=np.int32)
    where = np.flatnonzero(outside & (kind == 2))
    return int(depth[-1]) if len(depth) else 0, where, depth[where]


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``source, path, length, start``: one row per byte range of each file that has bytes."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(
        F.col("_metadata.file_path").alias("source"), "path", "length")
    return files.select("*", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("start"))


def _dealt(ranges: DataFrame) -> DataFrame:
    """Rows that stand for much reading, dealt out over tasks of their own."""
    count = ranges.count()
    tasks = max(1, min(count, max(16 * ranges.sparkSession.sparkContext.defaultParallelism, count // 64)))
    return ranges.repartition(tasks, "source", "start")


def _summaries(ranges: DataFrame, size: int) -> DataFrame:
    """What each range does, for a start outside a string (0) and within one (1)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, row in by_file(batch):
                escaped = is_escaped(file, row["start"])
                data = file.read_at(size, row["start"])
                quotes, kind = structure(data, escaped)
                both = [commas(quotes, kind, inside) for inside in (0, 1)]
                counts = [list(zip(*(v.tolist() for v in np.unique(depths, return_counts=True))))
                          for _, _, depths in both]
                text = data.lstrip(b" \t\r\n")
                yield pa.record_batch(
                    [pa.array([row["source"]]), pa.array([row["path"]]), pa.array([row["start"]]),
                     pa.array([text[:1].decode("latin-1") or None], pa.string()),
                     pa.array([int(quotes[-1])], pa.int64()),
                     *(pa.array([v], pa.int64()) for v, _, _ in both),
                     *(pa.array([c], pa.map_(pa.int32(), pa.int64())) for c in counts)],
                    ["source", "path", "start", "opening", "quotes", "depth0", "depth1", "commas0", "commas1"])

    return ranges.mapInArrow(
        read, "source string, path string, start bigint, opening string, quotes bigint, depth0 bigint, "
              "depth1 bigint, commas0 map<int,bigint>, commas1 map<int,bigint>")


def _before(ranges: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier ranges of the same file.

    Ranges are summed in blocks, and blocks by their sums, so that no task meets all
    ranges of a huge file.
    """
    def earlier(*keys: str, order: str):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    valued = ranges.withColumn("_value", value)
    sums = valued.groupBy("source", "block").agg(F.sum("_value").alias("_sum")).select(
        "source", "block", F.coalesce(F.sum("_sum").over(earlier("source", order="block")), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("_value").over(earlier("source", "block", order="start")), F.lit(0))
    return valued.join(sums, ["source", "block"]).withColumn(name, F.col("_base") + inner).drop(
        "_value", "_base")


def _placed(ranges: DataFrame, size: int) -> DataFrame:
    """Add how each range begins: ``inside`` a string or not, ``depth``, and ``first``, its commas before."""
    summaries = materialize(_summaries(_dealt(ranges), size), "json-ranges").withColumn(
        "block", F.floor(F.col("start") / (size * _BLOCK)))
    inside = _before(summaries, F.col("quotes"), "quotes_before").withColumn(
        "inside", F.col("quotes_before") % 2)
    is_inside = F.col("inside") == 1
    deep = _before(inside, F.when(is_inside, F.col("depth1")).otherwise(F.col("depth0")), "depth")
    held = F.when(is_inside, F.col("commas1")).otherwise(F.col("commas0"))
    separators = F.coalesce(F.try_element_at(held, (1 - F.col("depth")).cast("int")), F.lit(0))
    return materialize(_before(deep, separators, "first").select(
        "source", "path", "start", "opening", "inside", "depth", "first",
        (F.col("quotes_before") + F.col("quotes")).alias("quotes_after"),
        (F.col("depth") + F.when(is_inside, F.col("depth1")).otherwise(F.col("depth0"))).alias("depth_after")),
        "json-ranges")


def _elements(ranges: DataFrame, size: int) -> DataFrame:
    """``source, pos, element``: the texts between the commas that part a list's elements.

    A range gives the elements that begin in it, and reads on to the end of its last one.
    The list's own brackets are still on its first and last element.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, row in by_file(batch):
                yield one(file, row)

    def parting(data: bytes, escaped: bool, inside: int, depth: int) -> tuple[np.ndarray, int, int]:
        quotes, kind = structure(data, escaped)
        change, where, depths = commas(quotes, kind, inside)
        return where[depths + depth == 1], (inside + int(quotes[-1])) % 2, depth + change

    def one(file, row: dict) -> pa.RecordBatch:
        start = row["start"]
        data = file.read_at(size, start)
        cuts, inside, depth = parting(data, is_escaped(file, start), row["inside"], row["depth"])
        begins = [*([0] if start == 0 else []), *(cuts + 1).tolist()]
        pieces = [data[low:high - 1] for low, high in zip(begins, begins[1:])]
        if begins:
            last, end, step = [data[begins[-1]:]], start + len(data), min(size, _READ_ON)
            while more := file.read_at(step, end):
                cut, inside, depth = parting(more, is_escaped(file, end), inside, depth)
                last.append(more[:cut[0]] if len(cut) else more)
                end, step = end + len(more), min(size, 2 * step)
                if len(cut):
                    break
            pieces.append(b"".join(last))
        number = row["first"] + (0 if start == 0 else 1)
        return pa.record_batch(
            [pa.array([row["source"]] * len(pieces), pa.string()),
             pa.array(range(number, number + len(pieces)), pa.int64()),
             pa.array([p.decode("utf-8", "replace") for p in pieces], pa.string())],
            ["source", "pos", "element"])

    return ranges.select("source", "path", "start", "inside", "depth", "first").mapInArrow(
        read, "source string, pos bigint, element string")


def read_large_json_array(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Items of files that hold one JSON array each, as ``read_json_array`` gives them, for files of any size.

    A first pass finds what each range of ``range_bytes`` does to the nesting, for
    either way it may begin; prefix sums over the ranges, in blocks, tell how each one
    begins; a second pass cuts the elements out. Texts are never shuffled, and a task
    holds one range and one element. Rows are ``source, pos`` (place in the array), the
    item columns and ``file_error``. A file that is no list, or whose quotes or brackets
    do not pair up, becomes one rejected item; text behind the list is not looked for. An element that is no JSON value becomes a
    rejected item at its place and the others stay, where ``read_json_array`` rejects
    the file: finding out first would take another pass. Files of no bytes give nothing.
    """
    if range_bytes < 1:
        raise ValueError("range_bytes must be positive")
    ship_package(spark)
    ranges = _placed(_ranges(spark, path, range_bytes), range_bytes)
    opening = F.min_by("opening", F.when(F.col("opening").isNotNull(), F.col("start")))
    files = ranges.groupBy("source").agg(
        opening.alias("opening"), F.max_by("quotes_after", "start").alias("quotes"),
        F.max_by("depth_after", "start").alias("depth"))
    is_list = F.coalesce((F.col("opening") == "[") & (F.col("quotes") % 2 == 0) & (F.col("depth") == 0),
                         F.lit(False))
    files = materialize(files.select("source", is_list.alias("is_list")), "json-files")
    good, bad = files.filter("is_list").select("source"), files.filter("NOT is_list")

    found = _elements(_dealt(ranges.join(good, "source")), range_bytes)
    # The list's own closing bracket, on its last element, is past the end of what is parsed.
    opened = F.when(F.col("pos") == 0, F.col("element")).otherwise(F.concat(F.lit("["), "element"))
    listed = found.withColumn("_one", F.from_json(F.concat(opened, F.lit("]")), "array<string>"))
    is_empty_list = (F.col("pos") == 0) & F.col("element").rlike(r"\A[ \t\r\n]*\[[ \t\r\n]*\]")
    items = listed.filter(~is_empty_list).select(
        "source", "pos", F.try_element_at("_one", F.lit(1)).alias("item_json"),
        F.when(F.coalesce(F.size("_one"), F.lit(0)) != 1, NOT_JSON).alias("file_error"))
    rejected = bad.select("source", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("item_json"),
                          F.lit(NOT_AN_ARRAY).alias("file_error"))
    return parse_items(items.unionByName(rejected)).select("source", "pos", *ITEM_COLUMNS, "file_error")
