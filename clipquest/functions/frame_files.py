"""Names and encodings of extracted frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image types by file extension; anything else counts as JPEG.
IMAGE_TYPES = {
    "bmp": "image/bmp",
    "gif": "image/gif",
    "jpe": "image/jpeg",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "png": "image/png",
    "svg": "image/svg+xml",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "webp": "image/webp",
}
DEFAULT_IMAGE_TYPE = "image/jpeg"
FRAME_DIR_PREFIX = "_frames_"
FRAME_SUFFIX = ".jpg"
FIRST_FRAME_TAG = "ff0"
SCAN_TAG_PREFIX = "ls"


def file_stem(path: Column) -> Column:
    """File name without directory and last extension."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def parent_dir(path: Column) -> Column:
    """Directory part with its closing slash; empty when there is none."""
    return F.regexp_extract(path, r"\A(.*/)?", 0)


def seek_tag(t: Column) -> Column:
    """Tag of a frame found by its time: whole milliseconds."""
    return F.rint(t * 1000.0).cast("bigint").cast("string")


def scan_tag(idx: Column) -> Column:
    """Tag of a frame found by a linear scan."""
    return F.concat(F.lit(SCAN_TAG_PREFIX), idx.cast("string"))


def frame_prefix(video_path: Column) -> Column:
    """What the frame files of a video share: a folder beside it and its stem."""
    stem = file_stem(video_path)
    return F.concat(parent_dir(video_path), F.lit(FRAME_DIR_PREFIX), stem, F.lit("/"),
                    stem, F.lit("_"))


def frame_path(prefix: Column, tag: Column) -> Column:
    """File of one frame."""
    return F.concat(prefix, tag, F.lit(FRAME_SUFFIX))


def image_type(path: Column) -> Column:
    """Media type by file extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    known = F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ext), F.lit(DEFAULT_IMAGE_TYPE))


def data_url(content: Column, path: Column) -> Column:
    """File content as a data URL, without the line breaks Spark's base64 adds."""
    body = F.translate(F.base64(content), "\r\n", "")
    return F.concat(F.lit("data:"), image_type(path), F.lit(";base64,"), body)
