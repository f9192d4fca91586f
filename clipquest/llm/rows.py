"""What the corpus operators share: columns, Arrow batches and word hashes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of every contract: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
# No UTF-8 text holds this byte, so what starts with it is no word.
NO_WORD = b"\xff"


def documents(df: DataFrame, *more: str | Column) -> DataFrame:
    """``doc_id``, ``text`` (null: empty), ``text_hash`` and nothing else but ``more``.

    Further columns of ``df`` are left out, so their names cannot clash.
    ``(doc_id, text_hash)`` stands for a row; rows equal in both have equal results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                     F.xxhash64(text).alias("text_hash"), *more)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def fold(doc_id: str | Column, folds: int) -> Column:
    """CRC-32 of the id as text (null: empty text), modulo ``folds``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(folds))


def per_copy(df: DataFrame, copies: str) -> DataFrame:
    """Give every repeated row its own result again."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
                         ).drop("_copy", copies)


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def raw_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 18
                ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of some ``limit`` bytes: rows, their UTF-8 bytes and the offsets of each row."""
    names = batch.schema.get_field_index(column)
    start, rows = 0, batch.num_rows
    kind = batch.column(names).type
    width = np.int64 if pa.types.is_large_string(kind) else np.int32
    array = batch.column(names)
    if not rows:
        return
    offsets = np.frombuffer(array.buffers()[1], width)[array.offset:array.offset + rows + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    while start < rows:
        stop = int(np.searchsorted(offsets, int(offsets[start]) + limit, "right")) - 1
        stop = min(rows, max(stop, start + 1))
        low, high = int(offsets[start]), int(offsets[stop])
        yield (batch.slice(start, stop - start), data[low:high],
               (offsets[start:stop + 1] - low).astype(np.int64))
        start = stop


# Word hashes: a polynomial of the bytes, then a mixing step (splitmix64's constants).

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
# White space, and every ASCII character that is neither a letter nor a digit.
NOT_ALPHANUMERIC = _IS_SPACE.copy()
NOT_ALPHANUMERIC[:128] |= ~np.array([chr(i).isalnum() for i in range(128)])
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (size - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        steps = np.full((2, size), 1, np.uint64)
        steps[0, 1:], steps[1, 1:] = _BASE, _INVERSE
        _powers[size] = (np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1]))
    return _powers[size]


def _hash_piece(data: np.ndarray, starts_row: np.ndarray, breaks: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    space = breaks[data]
    first = ~space
    first[1:] &= space[:-1] | starts_row[1:]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    powers, inverse = _power_tables(len(data))
    values = (_LOWER[data] + np.uint64(1)) * powers[:len(data)]
    values[space] = 0
    return mix(np.add.reduceat(values, begins) * inverse[begins]), begins


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _IS_SPACE
                ) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) and the first word of each row.

    ``breaks`` says which bytes are no part of a word. Long inputs are hashed in
    pieces that end at such a byte or at a row's end.
    """
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets[:-1]] = True
    hashes, begins, low = [], [], 0
    while low < len(data):
        high = min(len(data), low + _PIECE)
        while high < len(data) and not (breaks[data[high]] or starts[high]):
            window = data[high:high + _PIECE]
            ends = np.flatnonzero(breaks[window] | starts[high:high + len(window)])
            high = high + int(ends[0]) if len(ends) else high + len(window)
        found, where = _hash_piece(data[low:high], starts[low:high], breaks)
        hashes.append(found)
        begins.append(where + low)
        low = high
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets, "left")


# Distinct words

def word_counts(docs: DataFrame, split: Callable[[str], Iterable], kind: str = "binary",
                parts: Callable[[str], Iterable] | None = None, flush: int = 300_000) -> DataFrame:
    """``word`` and ``n`` over all texts; each task adds up what it reads before the shuffle.

    With ``parts``, what ``split`` gives is counted first and then taken apart once.
    """
    arrow = pa.binary() if kind == "binary" else pa.string()

    def added_up(seen: Counter) -> pa.RecordBatch:
        if parts is not None:
            whole, seen = seen, Counter()
            for key, n in whole.items():
                for word in parts(key):
                    seen[word] += n
        return pa.record_batch([pa.array(list(seen.keys()), arrow),
                                pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py()))
                if len(seen) > flush:
                    yield added_up(seen)
                    seen.clear()
        if seen:
            yield added_up(seen)

    rows = docs.select("text").mapInArrow(count, f"word {kind}, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))



def most_frequent(words: DataFrame, limit: int) -> DataFrame:
    """Words of the highest counts ``n``, at most ``limit``; without a sort of all words.

    Counts are put in classes of some 4 %. Of the classes, as many as fit in whole are taken.
    """
    size = F.floor(F.log2("n") * 16)
    classes = words.groupBy(size.alias("size")).agg(F.count("*").alias("words"))
    lowest, taken = 1 << 30, 0
    for row in sorted(classes.collect(), key=lambda r: -r["size"]):
        taken += row["words"]
        if taken > limit:
            break
        lowest = row["size"]
    return words.filter(size >= lowest)
