"""Which file belongs to which video id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquest.operators.skew import SkewPolicy, lookup_join

# Video file extensions, best first.
VIDEO_EXTENSIONS = ("mp4", "mkv", "mov")


def extension_rank(ext: Column) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in VIDEO_EXTENSIONS]), ext)


def best_assets(manifest: DataFrame, videos_dir: str) -> DataFrame:
    """One ``(id, video_path)`` per id.

    A file in the root beats one in the id's folder, then the extension
    decides, then the path. Every id is reduced before the shuffle.
    """
    order = F.struct("in_subdir", extension_rank(F.col("ext")).alias("rank"), "rel_path")
    path = F.concat(F.lit(videos_dir.rstrip("/") + "/"), F.col("best.rel_path"))
    return (manifest.groupBy("id").agg(F.min(order).alias("best"))
            .select("id", path.alias("video_path")))


def resolve_videos(items: DataFrame, assets: DataFrame, spread: list[str],
                   policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Add ``video_path`` to every item; NULL where the id has no file."""
    return lookup_join(items, assets, ["id"], spread=spread, how="left", policy=policy)
