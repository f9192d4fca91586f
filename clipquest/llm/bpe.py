"""Byte-level BPE: encode each distinct pre-token once, put documents together, decode."""

from __future__ import annotations

import base64
import functools
import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from clipquest.llm.rows import documents, most_frequent, text_slices, word_counts
from clipquest.session import materialize

# No match of the pattern goes on over a space that a character other than white
# space follows, so texts may be cut before such spaces.
_CUT, _ODD_SPACE = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in content.splitlines() if line.strip())}


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=parse_ranks(ranks),
                             special_tokens={})


@functools.lru_cache(maxsize=2)
def _token_bytes(ranks: bytes) -> list[bytes]:
    table = parse_ranks(ranks)
    out = [b""] * (max(table.values(), default=-1) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


def words_of(text: str) -> list[str]:
    """The parts of a text between such spaces; each begins with the space before it.

    In what is returned that space is left out, and the first part has one that
    is not in the text, so that most texts need no more than a split.
    """
    return (text.split(" ") if not _ODD_SPACE.search(text) else _CUT.split(text)) if text else []


def _written(text: str) -> list[str]:
    """Words of a text; the first is marked by a space."""
    words = words_of(text)
    if words:
        words[0] = " " + words[0]
    return words


def _read(word: str) -> str:
    return word[1:] if word.startswith(" ") else " " + word


def _ids(encoding, word: str) -> bytes:
    return np.array(encoding.encode_ordinary(_read(word)), "<u4").tobytes()


def frequent_words(rows: DataFrame, frequent: int, one_in: int = 8) -> DataFrame:
    """At most ``frequent`` words ``word, n``, the most frequent of one row in ``one_in``.

    Which words these are decides only how ids travel, never which they are, so
    counts of a part of the rows do.
    """
    part = rows.filter(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(one_in)) == 0)
    return most_frequent(materialize(word_counts(part, _written, "string"), "frequent"), frequent)


# Words or their ids with their numbers in a block, as one compressed value.

def _pack(slots: np.ndarray, values: list[bytes]) -> bytes:
    import zstandard

    sizes = np.array([len(v) for v in values], "<u4")
    columns = np.concatenate([np.diff(slots, prepend=0).astype("<u4"), sizes])
    body = b"".join([np.array([len(values)], "<u4").tobytes(),
                     columns.view(np.uint8).reshape(-1, 4).T.tobytes(), *values])
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(data: bytes) -> tuple[list[int], list[bytes]]:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(body, "<u4", 1)[0])
    columns = np.frombuffer(body, np.uint8, 8 * n, 4).reshape(4, -1).T
    columns = np.ascontiguousarray(columns).view("<u4").ravel().astype(np.int64)
    ends = 4 + 8 * n + np.cumsum(columns[n:])
    starts = np.concatenate([[4 + 8 * n], ends[:-1]]) if n else ends
    return np.cumsum(columns[:n]).tolist(), [body[i:j] for i, j in zip(starts.tolist(), ends.tolist())]


def encode(docs: DataFrame, ranks: bytes, pattern: str, frequent: int = 200_000) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_tokens`` and ``ids`` (unsigned 32-bit, little-endian) per row.

    ``ranks`` is the content of a rank file; every match of ``pattern`` is encoded
    separately. In the pattern a space may only lead a match or be white space
    before white space.

    Words are looked at once each: the ``frequent`` ones (a fixed number) in a
    table that is broadcast, which also keeps hot words out of the shuffle; the
    others are dealt out by hash, so that all places of a word meet. A block is
    some MB of documents. It is written as the sequence of its words' numbers, in
    text order. Numbers of frequent words hold everywhere; the others are the
    block's own, each distinct word once, and their ids are brought back to the
    block, where documents are put together. Texts themselves are not shuffled.
    A task remembers at most a fixed number of words at a time.

    A null or empty text gives no ids. Null and repeated ids keep their rows;
    further columns are ignored; an empty table gives none.
    """
    spark, rows = docs.sparkSession, documents(docs).select("doc_id", "text", "text_hash")
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        for batch in batches:
            ids = [_ids(encoding, w) for w in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())],
                                  ["word", "n", "ids"])

    head = frequent_words(rows, frequent).mapInArrow(
        encode_words, "word string, n bigint, ids binary").toArrow().sort_by(
        [("n", "descending"), ("word", "ascending")])
    words, ids_of = (head.column(c).to_pylist() for c in ("word", "ids"))
    size = len(words)
    known = spark.sparkContext.broadcast({word: i for i, word in enumerate(words)})
    known_ids = spark.sparkContext.broadcast((
        np.frombuffer(b"".join(ids_of), "<u4"),
        np.cumsum([0, *(len(x) // 4 for x in ids_of)], dtype=np.int64)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Key, rows, lengths and numbers of each block, and its words that are not frequent."""
        get = known.value.get
        for batch in batches:
            for part, _, _ in text_slices(batch, limit=1 << 20):
                ids, hashes = part.column(0).to_pylist(), part.column(2).to_pylist()
                key = hashlib.blake2b(repr((ids, hashes)).encode(), digest_size=16).digest()
                own: dict[str, int] = {}
                codes, counts = [], []
                for text in part.column(1).to_pylist():
                    words = _written(text)
                    found = [get(w, -1) for w in words]
                    if -1 in found:
                        found = [own.setdefault(w, len(own)) + size if f < 0 else f
                                 for w, f in zip(words, found)]
                    codes.append(np.array(found, "<u4"))
                    counts.append(len(found))
                yield key, ids, hashes, counts, codes, own

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for key, ids, hashes, counts, codes, own in blocks(batches):
            # One byte plane after the other: numbers are ranks, so high planes are nearly zero.
            planes = np.concatenate(codes).view(np.uint8).reshape(-1, 4).T.tobytes()
            data = pickle.dumps((ids, hashes, counts, len(own), press.compress(planes)))
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([1], pa.int32()),
                                   pa.array([data], pa.binary())], ["block", "kind", "data"])

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, _, _, own in blocks(batches):
            values = [w.encode("utf-8", "surrogatepass") for w in own]
            deal = np.array([zlib.crc32(v) % deals for v in values], np.int64)
            order = np.argsort(deal, kind="stable")
            cuts = np.flatnonzero(np.diff(deal[order], prepend=-1))
            packed = [_pack(part, [values[i] for i in part.tolist()])
                      for part in np.split(order, cuts[1:]) if len(part)]
            yield pa.record_batch(
                [pa.array(deal[order][cuts], pa.int32()), pa.array([key] * len(packed), pa.binary()),
                 pa.array(packed, pa.binary())], ["deal", "block", "data"])

    def encode_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        seen: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for data in batch.column(2):
                slots, words = _unpack(data.as_py())
                if len(seen) > 200_000:
                    seen.clear()
                for word in words:
                    if word not in seen:
                        seen[word] = _ids(encoding, word.decode("utf-8", "surrogatepass"))
                out.append(_pack(np.array(slots, np.int64), [seen[w] for w in words]))
            yield pa.record_batch([batch.column(1), pa.array([0] * len(out), pa.int32()),
                                   pa.array(out, pa.binary())], ["block", "kind", "data"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        flat, ends = known_ids.value
        block, own = None, {}
        for batch in batches:
            for key, kind, data in zip(*(batch.column(i) for i in range(3))):
                key, data = key.as_py(), data.as_py()
                if key != block:
                    block, own = key, {}
                if not kind.as_py():
                    own.update(zip(*_unpack(data)))
                    continue
                ids, hashes, counts, words, pressed = pickle.loads(data)
                planes = np.frombuffer(unpress.decompress(pressed), np.uint8)
                codes = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
                mine = [own[i] for i in range(words)]
                stops = np.cumsum([0, *(len(m) // 4 for m in mine)], dtype=np.int64)
                yield _rows(ids, hashes, counts, codes.astype(np.int64),
                            np.concatenate([flat, np.frombuffer(b"".join(mine), "<u4")]),
                            np.concatenate([ends, ends[-1] + stops[1:]]))

    rare = rows.mapInArrow(rare_words, "deal int, block binary, data binary")
    parts = rare.repartition("deal").mapInArrow(encode_rare, "block binary, kind int, data binary")
    skeleton = rows.mapInArrow(skeletons, "block binary, kind int, data binary")
    together = parts.union(skeleton).repartition("block").sortWithinPartitions("block", "kind")
    return together.mapInArrow(
        put_together, "doc_id bigint, text_hash bigint, n_tokens bigint, ids binary")


def _rows(ids: list, hashes: list, counts: list, numbers: np.ndarray, table: np.ndarray,
          stops: np.ndarray) -> pa.RecordBatch:
    """The ids of each document of a block: those of its words, one after the other."""
    starts = stops[numbers]
    sizes = stops[numbers + 1] - starts
    total = np.concatenate([[0], np.cumsum(sizes)])
    tokens = table[np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)]
    cuts = total[np.cumsum([0, *counts], dtype=np.int64)]
    data = [tokens[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(np.diff(cuts), pa.int64()),
         pa.array(data, pa.binary())], ["doc_id", "text_hash", "n_tokens", "ids"])


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Add ``decoded``: the bytes of the ``ids`` by the broadcast token-byte table.

    The table has as many rows as the vocabulary, whatever the corpus. An id
    that is not in it fails the job.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(ranks)
        for batch in batches:
            data = [None if ids is None else
                    b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                    for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())],
                                             [*batch.schema.names, "decoded"])

    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    return encoded.mapInArrow(look_up, schema)
