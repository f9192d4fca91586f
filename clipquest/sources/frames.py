"""Frame images as data URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquest.functions.frame_files import data_url
from clipquest.operators.skew import SkewPolicy, lookup_join


def read_frame_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of frame files.

    Name the frame folders themselves: a recursive listing from above skips
    folders that start with an underscore.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content")


def with_data_urls(selected: DataFrame, files: DataFrame, key: list[str], cap: int,
                   policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Add ``urls``: the earliest ``cap`` frames of every row as data URLs, in order.

    ``files.path`` must be written as the frame paths are. A frame without a file
    gives its row a ``frame_error``, so that no question is asked without frames
    that were planned. Works on plan keys, so a frame is encoded once per plan and
    not once per question, and only frames that a plan wants are encoded.
    ``selected`` is read more than once, so pass a stored table.
    """
    wanted = selected.select(*key, F.posexplode(F.slice("frames.path", 1, cap)).alias("n", "path"))
    found = lookup_join(wanted, files.select("path", "content"), ["path"], spread=key, how="left",
                        policy=policy)
    encoded = found.select(*key, "n", "path", data_url(F.col("content"), F.col("path")).alias("url"))
    lost = F.min(F.when(F.col("url").isNull(), F.struct("n", "path")))
    urls = encoded.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("n", "url")))).alias("_u"),
        lost.alias("_lost"))
    missing = F.concat(F.lit("FileNotFoundError: "), F.col("_lost.path"))
    return (selected.join(urls, key, "left")
            .withColumn("urls", F.coalesce("_u.url", F.array().cast("array<string>")))
            .withColumn("frame_error", F.coalesce("frame_error", missing))
            .drop("_u", "_lost"))
