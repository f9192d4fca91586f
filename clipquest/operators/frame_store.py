"""Frame files fetched next to the model, so that image bytes never travel with questions."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.functions.frame_files import DEFAULT_IMAGE_TYPE, IMAGE_TYPES
from clipquest.operators.worker import Backend

# The contents of those paths that there is a file for.
Fetch = Callable[[list[str]], dict[str, bytes]]
_EXTENSION = re.compile(r"\.([^./]+)\Z")


def data_url(path: str, content: bytes) -> str:
    """What ``functions.frame_files.data_url`` gives, for one file."""
    found = _EXTENSION.search(path)
    kind = IMAGE_TYPES.get(found.group(1).lower() if found else "", DEFAULT_IMAGE_TYPE)
    return f"data:{kind};base64,{base64.b64encode(content).decode()}"


@dataclass(frozen=True)
class FolderFrames:
    """Frames as single files, named by their paths below ``root``; a folder or a store's address."""

    root: str = ""

    def __call__(self) -> Fetch:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.root) if "://" in self.root else (
            fs.LocalFileSystem(), self.root)

        def fetch(paths: list[str]) -> dict[str, bytes]:
            names = [f"{base.rstrip('/')}/{p}" if base else p for p in paths]
            out = {}
            for path, info in zip(paths, files.get_file_info(names)):
                if info.is_file:
                    with files.open_input_stream(info.path) as stream:
                        out[path] = stream.read()
            return out

        return fetch


def bucket_of(path: str, buckets: int) -> int:
    return zlib.crc32(path.encode()) % buckets


def pack_frames(files: DataFrame, target: str, buckets: int = 64, row_group: int = 4 << 20) -> PackedFrames:
    """Write ``(path, content)`` as Parquet buckets by a hash of the path, sorted by path.

    Many small files become few large ones, of which a reader takes the row
    groups that can hold its paths. Of several contents of a path one stays.
    """
    bucket = F.pmod(F.crc32(F.encode("path", "utf-8")), F.lit(buckets)).cast("int").alias("bucket")
    rows = files.filter("path is not null and content is not null").select("path", "content", bucket)
    (rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "path")
     .write.mode("errorifexists").option("parquet.block.size", row_group).partitionBy("bucket").parquet(target))
    return PackedFrames(target, buckets)


@dataclass(frozen=True)
class PackedFrames:
    """Frames packed by :func:`pack_frames` at ``target``.

    A worker keeps the buckets' footers and the last row group of each, so paths
    asked for in rising order cost one reading of the range that they span.
    """

    target: str
    buckets: int = 64

    def __call__(self) -> Fetch:
        from pyarrow import fs

        address = self.target.removeprefix("file:") if self.target.startswith("file:") else self.target
        files, base = fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)
        opened: dict[int, list[_SortedFile]] = {}

        def bucket_files(bucket: int) -> list[_SortedFile]:
            if bucket not in opened:
                found = files.get_file_info(fs.FileSelector(f"{base}/bucket={bucket}", allow_not_found=True))
                opened[bucket] = [_SortedFile(files.open_input_file(info.path)) for info in found
                                  if info.is_file and not info.base_name.startswith((".", "_"))]
            return opened[bucket]

        def fetch(paths: list[str]) -> dict[str, bytes]:
            wanted: dict[int, list[str]] = {}
            for path in paths:
                wanted.setdefault(bucket_of(path, self.buckets), []).append(path)
            out: dict[str, bytes] = {}
            for bucket, names in wanted.items():
                for packed in bucket_files(bucket):
                    out.update(packed.contents(sorted(names)))
            return out

        return fetch


class _SortedFile:
    """One packed file, sorted by path: the ranges of its row groups, and the last one read.

    Requests in the order of their paths read each row group once.
    """

    def __init__(self, source):
        import pyarrow.parquet as pq

        self.file = pq.ParquetFile(source)
        place = self.file.schema_arrow.get_field_index("path")
        groups = (self.file.metadata.row_group(i).column(place) for i in range(self.file.num_row_groups))
        bounds = [g.statistics for g in groups]
        known = all(b is not None and b.has_min_max for b in bounds)
        # Without bounds, as paths of over 4 KB leave it, every row group may hold a path.
        self.first = [b.min for b in bounds] if known else None
        self.last = [b.max for b in bounds] if known else None
        self.number, self.paths, self.bytes = None, None, None

    def _groups(self, name: str) -> Iterable[int]:
        if self.first is None:
            return range(self.file.num_row_groups)
        group = bisect_right(self.first, name) - 1
        return (group,) if group >= 0 and name <= self.last[group] else ()

    def contents(self, names: list[str]) -> Iterable[tuple[str, bytes]]:
        """Those of the names that the file has; in their order, row groups are read in theirs."""
        for name in names:
            for group in self._groups(name):
                if group != self.number:
                    table = self.file.read_row_group(group, columns=["path", "content"])
                    self.paths, self.bytes = (table.column(i).combine_chunks() for i in (0, 1))
                    self.number = group
                rows = len(self.paths)
                row = bisect_left(range(rows), name, key=lambda i: self.paths[i].as_py())
                if row < rows and self.paths[row].as_py() == name:
                    yield name, self.bytes[row].as_py()
                    break


class _Recent:
    """Encoded frames of the last requests, up to a number of bytes; plans share many."""

    def __init__(self, fetch: Fetch, most: int):
        self.fetch, self.most, self.size = fetch, most, 0
        self.urls: OrderedDict[str, str] = OrderedDict()

    def of(self, paths: Iterable[str]) -> dict[str, str]:
        out, missing = {}, []
        for path in dict.fromkeys(paths):
            if path in self.urls:
                self.urls.move_to_end(path)
                out[path] = self.urls[path]
            else:
                missing.append(path)
        for path, content in (self.fetch(missing) if missing else {}).items():
            out[path] = self.urls[path] = data_url(path, content)
            self.size += len(out[path])
        while self.size > self.most:
            self.size -= len(self.urls.popitem(last=False)[1])
        return out


def _refs(request: dict) -> list[str]:
    return [ref for message in request["messages"] for part in message["content"] for ref in part["refs"] or ()]


def _with_urls(request: dict, urls: dict[str, str]) -> dict:
    return {**request, "messages": [
        {**message, "content": [{**part, "refs": [urls[r] for r in part["refs"]]} if part["refs"] else part
                                for part in message["content"]]} for message in request["messages"]]}


def fetching_backend(make_backend: Callable[[], Backend], make_store: Callable[[], Fetch],
                     cache_bytes: int = 64 << 20) -> Callable[[], Backend]:
    """A backend whose requests name frames by path, for one that wants data URLs.

    Each call fetches the distinct paths of its requests in the worker, and encodes
    them there; ``cache_bytes`` bounds what is kept for later calls. A request
    with a frame that has no file is not asked and fails with the first such path.
    """

    def make() -> Backend:
        backend, recent = make_backend(), _Recent(make_store(), cache_bytes)

        def ask(requests: list[dict]) -> list[str | Exception]:
            urls = recent.of(ref for request in requests for ref in _refs(request))
            lost = [next((r for r in _refs(request) if r not in urls), None) for request in requests]
            replies = iter(backend([_with_urls(request, urls) for request, gone in zip(requests, lost)
                                    if gone is None]) if None in lost else ())
            return [next(replies) if gone is None else FileNotFoundError(gone) for gone in lost]

        return ask

    return make
