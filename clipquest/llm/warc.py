"""WARC archives of web pages: a deterministic sharded writer, and a reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquest.session import materialize


@dataclass(frozen=True)
class ArchiveFormat:
    """``shard_bytes`` of payload make a shard; files roll at ``file_bytes`` after compression.

    Payloads of ``revisit_bytes`` or more are written once. ``date`` is every
    record's date, as pages have none. ``cells`` bounds what the driver sees of
    the ids' distribution.
    """

    prefix: str = "pages"
    shard_bytes: int = 32 << 20
    file_bytes: int = 16 << 20
    revisit_bytes: int = 0
    date: str = "2020-01-01T00:00:00Z"
    level: int = 6
    cells: int = 1 << 16


_ARCHIVES, _PENDING, _MANIFEST = "archives", "pending", "manifest"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORD_IDS, f'{page_id}/{digest}')}>"


def _header_text(value: str) -> str:
    """A header's value in one line: control characters and spaces percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode())
                   for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None,
           config: ArchiveFormat) -> bytes:
    """A response record, or a revisit of page ``first``, which has the same payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {config.date}"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if first is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}",
                  f"WARC-Refers-To-Page-ID: {first}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _information(name: str, config: ArchiveFormat) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = ("WARC/1.1\r\nWARC-Type: warcinfo\r\n"
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_RECORD_IDS, name)}>\r\nWARC-Date: {config.date}\r\n"
            f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\n"
            f"Content-Length: {len(block)}\r\n\r\n")
    return head.encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """A gzip member without a time, so that equal records give equal bytes."""
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _pages(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"),
                        F.octet_length(html).cast("bigint").alias("bytes"))


def _first_ids(sizes: DataFrame, config: ArchiveFormat) -> list[int]:
    """The first id of each shard but the first.

    Ids are put in at most ``cells`` cells of equal width; those that hold more
    than a shard are cut into finer ones, all in one job, until none does or it
    is a single id. Neighbouring cells are taken together up to a shard. So
    shards follow from the rows alone, not from a sample, however ids are spread.
    A shard has ``shard_bytes``, or more where there would be over ``cells`` shards.
    """
    size = F.sum(F.col("bytes") + 512)
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), size).first()
    if low is None:
        return []
    target = max(config.shard_bytes, total // config.cells)
    width = 1 << max(0, ((high - low) // config.cells).bit_length())

    def cell(step: int):
        return F.floor((F.col("page_id") - F.lit(low)) / F.lit(step)).cast("bigint")

    rows, found = sizes.filter("page_id is not null"), []
    while True:
        cells = [tuple(r) for r in rows.groupBy(cell(width).alias("cell")).agg(size).collect()]
        large = [c for c, held in cells if held > target and width > 1]
        found += [(low + c * width, held) for c, held in cells if held <= target or width == 1]
        if not large:
            break
        wanted = sizes.sparkSession.createDataFrame([(c,) for c in large], "cell bigint")
        rows = sizes.withColumn("cell", cell(width)).join(F.broadcast(wanted), "cell", "left_semi")
        width = max(1, width >> max(4, (config.cells // len(large)).bit_length() - 1))
    starts, filled = [], 0
    for first, held in sorted(found):
        if filled and filled + held > target:
            starts.append(first)
            filled = 0
        filled += held
    return starts


def write_archives(pages: DataFrame, target: str, config: ArchiveFormat = ArchiveFormat()) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) below ``target``; the manifest's rows.

    Of pages with equal payloads the one with the smallest id is a response, the
    others revisit it. Pages are range-sorted by id into shards that depend on
    the rows alone; within a shard files roll by compressed size, and every
    header and digest is made anew, so the same pages give the same bytes under
    the same names. Digests and ids alone decide revisits: equal payloads are
    counted before they are shuffled, and pages meet their verdicts in the sort,
    so each payload is moved once.

    A task writes under a name of its own in ``pending``; its rows of the manifest
    count only if the task's result does. Then files get their final names in
    ``archives``, and last the manifest is written under another name and renamed.
    A reader takes only what a manifest lists. A task that runs again only leaves
    a pending file more, and a second rename finds its work done.

    A null html is an empty payload. A null id gives a record without one, which
    is never visited again; if the payload has no page with an id, it is a
    response. Rows repeated with the smallest id are all responses. A null url is
    left out. Further columns are ignored. An empty table gives a manifest of no files.
    """
    spark, rows = pages.sparkSession, _pages(pages)
    digests = materialize(rows.select("page_id", "bytes", F.sha1("html").alias("sha1")), "digests")
    firsts = digests.filter(F.col("bytes") >= config.revisit_bytes).groupBy("sha1", "bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    # Written first: AQE splits hot payloads only where both sides come right from a shuffle.
    firsts = materialize(firsts, "payloads")
    verdicts = digests.join(firsts, ["sha1", "bytes"]).filter(
        "first is not null and not (page_id <=> first)").select("page_id", "sha1", "first").distinct()

    firsts_of = _first_ids(digests, config)
    placed = F.when(F.col("page_id").isNull(), len(firsts_of)).otherwise(
        _shard_of(firsts_of)).cast("int").alias("shard")
    both = rows.select(placed, "page_id", F.lit(1).alias("kind"), "url", "html",
                       F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("bigint").alias("first")
                       ).unionByName(verdicts.select(
                           placed, "page_id", F.lit(0).alias("kind"), "sha1", "first"),
                           allowMissingColumns=True)
    dealt = both.repartitionById(len(firsts_of) + 1, F.col("shard")).sortWithinPartitions(
        "shard", F.asc_nulls_last("page_id"), "kind", "url", F.xxhash64("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(target)
        attempt, state = uuid.uuid4().hex, {"shard": None}

        def opened(shard: int, number: int) -> None:
            name = f"{config.prefix}-{shard:06d}-{number:04d}.warc.gz"
            pending = posixpath.join(root, _PENDING, f"{name}.{attempt}")
            start = _member(_information(name, config), config.level)
            state.update(shard=shard, number=number, name=name, pending=pending, records=0,
                         size=len(start), out=system.open_output_stream(pending, compression=None),
                         sum=hashlib.sha256(start))
            state["out"].write(start)

        def closed() -> pa.RecordBatch:
            state["out"].close()
            return pa.record_batch([pa.array([state[c]]) for c in ("shard", "number", "name", "pending",
                                                                   "records", "size")]
                                   + [pa.array([state["sum"].hexdigest()])],
                                   ["shard", "number", "name", "pending", "records", "bytes", "sha256"])

        seen: tuple = ()
        system.create_dir(posixpath.join(root, _PENDING), recursive=True)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                columns = (part.column(i).to_pylist() for i in range(part.num_columns))
                for shard, page_id, kind, url, html, sha1, first in zip(*columns):
                    if seen != (shard, page_id):
                        seen, known = (shard, page_id), {}
                    if not kind:
                        known[sha1] = first
                        continue
                    if state["shard"] != shard:
                        if state["shard"] is not None:
                            yield closed()
                        opened(shard, 0)
                    elif state["size"] >= config.file_bytes:
                        yield closed()
                        opened(shard, state["number"] + 1)
                    payload = html.encode("utf-8", "surrogatepass")
                    raw = hashlib.sha1(payload)
                    data = _member(record(page_id, url, payload, base64.b32encode(raw.digest()).decode(),
                                          known.get(raw.hexdigest()), config), config.level)
                    state["out"].write(data)
                    state["sum"].update(data)
                    state["size"] += len(data)
                    state["records"] += 1
        if state["shard"] is not None:
            yield closed()

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(target)
        system.create_dir(posixpath.join(root, _ARCHIVES), recursive=True)
        for batch in batches:
            for name, pending, size in zip(*(batch.column(c).to_pylist()
                                             for c in ("name", "pending", "bytes"))):
                final = posixpath.join(root, _ARCHIVES, name)
                if system.get_file_info(pending).type == fs.FileType.File:
                    system.move(pending, final)
                if system.get_file_info(final).size != size:
                    raise OSError(f"{final} is not the {size} bytes that were written")
            yield batch

    kind = "shard int, number int, name string, pending string, records bigint, bytes bigint, sha256 string"
    written = materialize(dealt.mapInArrow(_typed(write), kind), "archives")
    named = materialize(written.mapInArrow(rename, kind), "archives").drop("pending")
    system, root = _place(target)
    temporary = f"{target}/{_MANIFEST}.{uuid.uuid4().hex}"
    named.write.json(temporary)
    system.move(_place(temporary)[1], posixpath.join(root, _MANIFEST))
    return named


def _typed(write):
    """The manifest's integer types."""
    schema = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("name", pa.string()),
                        ("pending", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
                        ("sha256", pa.string())])

    def typed(batches):
        for batch in write(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)],
                                             schema=schema)

    return typed


def _shard_of(first_ids: list[int]):
    """The number of first ids up to ``page_id``, by binary search in one constant array."""
    if not first_ids:
        return F.lit(0)
    edges = F.split(F.lit(",".join(map(str, first_ids))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(len(first_ids).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda below, step: F.when(
        F.get(edges, below + step - 1) <= F.col("page_id"), below + step).otherwise(below))


def _records(data: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    with gzip.open(data) as stream:
        while line := stream.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"no record begins with {line[:40]!r}")
            head = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b": ")
                head[name.decode().lower()] = value.decode("utf-8", "surrogatepass")
            block = stream.read(int(head["content-length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {head.get('warc-record-id')} has another length")
            yield head, block


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """Records below ``target``: ``page_id, url, record_type, refers_to, payload_digest,
    payload_bytes, payload`` (null for revisits).

    Files must be those of the manifest. Block and payload digests are worked out
    again; a record with another one fails the job. Workers read files as streams,
    so a task holds some megabytes of records, however many files it takes.
    """
    manifest = spark.read.schema("name string, bytes bigint, records bigint").json(f"{target}/{_MANIFEST}")
    kind = ("page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
            "payload_bytes bigint, payload binary")
    if manifest.isEmpty():
        return spark.createDataFrame([], kind)
    files = spark.read.format("binaryFile").load(f"{target}/{_ARCHIVES}")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    listed = files.select(name, F.col("length").alias("bytes"))
    if not listed.join(manifest, ["name", "bytes"], "full").filter("records is null").isEmpty() or (
            listed.count() != manifest.count()):
        raise ValueError(f"the archives below {target} are not those of its manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(target)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                out: list[tuple] = []
                size = 0
                data = system.open_input_stream(posixpath.join(root, _ARCHIVES, archive), compression=None)
                for head, block in _records(data):
                    if head["warc-type"] == "warcinfo":
                        continue
                    if head["warc-block-digest"] != f"sha1:{_digest(block)}":
                        raise ValueError(f"block digest of {head['warc-record-id']}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    response = head["warc-type"] == "response"
                    if response and _digest(payload) != digest:
                        raise ValueError(f"payload digest of {head['warc-record-id']}")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    number, refers = head.get("warc-page-id"), head.get("warc-refers-to-page-id")
                    out.append((number and int(number), head.get("warc-target-uri"), head["warc-type"],
                                refers and int(refers), digest, length, payload if response else None))
                    size += len(block)
                    if size > 1 << 22:
                        yield _batch(out)
                        out, size = [], 0
                data.close()
                if out:
                    yield _batch(out)

    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                               [c.split()[0] for c in kind.split(", ")])

    return files.select(name).mapInArrow(read, kind)
