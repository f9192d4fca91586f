"""Manifests of video files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquest.operators.assets import VIDEO_EXTENSIONS
from clipquest.session import materialize

MANIFEST_SCHEMA = "id string, rel_path string, in_subdir boolean, ext string"
_VIDEO = r"\A(.*)\.({})\z".format("|".join(VIDEO_EXTENSIONS))


def assets_from_paths(paths: DataFrame, rel_path: Column | str = "rel_path") -> DataFrame:
    """Manifest of paths relative to the video root, such as a storage inventory.

    A path serves the id that is its name without the extension, folders included,
    and the id that is its folder. Extensions are lower-case video extensions.
    Names that start with ``_`` or ``.`` stay, unlike in Spark's own file listings.
    """
    rel = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    stem, ext = (F.regexp_extract(rel, _VIDEO, i) for i in (1, 2))
    folder = F.regexp_extract(rel, r"\A(.+)/[^/]*\z", 1)
    serves = F.explode(F.array(
        F.struct(F.when(~F.endswith("stem", F.lit("/")), F.col("stem")).alias("id"),
                 F.lit(False).alias("in_subdir")),
        F.struct(F.nullif("folder", F.lit("")).alias("id"), F.lit(True).alias("in_subdir"))))
    return (paths.filter(rel.rlike(_VIDEO))
            .select(rel.alias("rel_path"), stem.alias("stem"), folder.alias("folder"), ext.alias("ext"))
            .select("rel_path", "ext", serves.alias("s"))
            .select("s.id", "rel_path", "s.in_subdir", "ext")
            .filter(F.col("id") != ""))


def scan_assets(spark: SparkSession, root: str, parallelism: int | None = None) -> DataFrame:
    """Manifest of a mounted folder, listed on the executors.

    One task streams the names in the root; the folders among them are spread
    over tasks and listed there. Prefer a stored inventory for object stores.
    """
    names = spark.createDataFrame([(root,)], "folder string").mapInPandas(
        _list_folder, "rel_path string, is_dir boolean")
    # Stored, as files and folders are taken from it in turn.
    names = materialize(names, "names").repartition(
        parallelism or spark.sparkContext.defaultParallelism, "rel_path")
    top = names.filter(~F.col("is_dir")).select("rel_path")
    below = (names.filter("is_dir")
             .select(F.concat(F.lit(root.rstrip("/") + "/"), "rel_path").alias("folder"),
                     F.concat("rel_path", F.lit("/")).alias("prefix"))
             .mapInPandas(_list_folder, "rel_path string, is_dir boolean")
             .filter(~F.col("is_dir")).select("rel_path"))
    return assets_from_paths(top.unionByName(below))


def _list_folder(batches, chunk: int = 10_000):
    import pandas as pd

    for batch in batches:
        prefixes = batch["prefix"] if "prefix" in batch else [""] * len(batch)
        for folder, prefix in zip(batch["folder"], prefixes):
            rows = []
            with os.scandir(folder) as entries:
                for entry in entries:
                    rows.append((prefix + entry.name, entry.is_dir()))
                    if len(rows) == chunk:
                        yield pd.DataFrame(rows, columns=["rel_path", "is_dir"])
                        rows = []
            yield pd.DataFrame(rows, columns=["rel_path", "is_dir"])
