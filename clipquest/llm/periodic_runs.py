"""Stretches of words that repeat with a period, found through dictionaries of basic factors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.llm.rows import documents, raw_words

# Documents of together so many words are worked on at once; a longer one alone.
_WORDS = 1 << 17

WordsOf = Callable[[int | None, str], list[bytes]]


def plain_words(doc_id: int | None, text: str) -> list[bytes]:
    return raw_words(text)


def repeated_tail(doc_id: int | None, text: str) -> list[bytes]:
    """Words of a text; those of every tenth id go on periodically from some word on.

    With h the CRC-32 of the id as text (null: empty text) and g = h div 10: where
    h mod 10 is 0, word i from a = g mod n on becomes word a + (i - a) mod p, and p is
    1 + (n - a) div (3 + g mod 8).
    """
    words = raw_words(text)
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of keys, and the order that sorts equal keys together, earlier ones first."""
    order = np.argsort(keys, kind="stable")
    first = np.diff(keys[order], prepend=keys[order[:1]] - 1) != 0
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(first) - 1
    return names, order, first


def runs_of(words: np.ndarray, starts: np.ndarray, least: int = 6, times: int = 4
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, sorted by start and period.

    ``words`` are the numbers of the words of several documents, which begin at
    ``starts`` (with the end last). A run is a stretch with smallest period q that
    no neighbour in its document extends, of ``least`` words and ``times`` (three or
    more) periods at least.

    The dictionary names, for each power of two, the stretches (factors) of that
    many words; the name of a factor comes from the names of its halves. Only places
    whose factor occurs again in the document can have a longer one that does, so
    others leave the dictionary as it grows.

    Occurrences of a factor that begin at most its length apart form arithmetic
    progressions. Where the next occurrence after place i is d further on, the
    stretch from i to that occurrence's end has the smallest period d. In a run of
    period q each place does so with d = q, up to the last factor that fits twice;
    so consecutive places with the same d are one run, and it can't be extended.
    The first power of two of q or more is less than 2 q, so a factor of that length
    fits twice into three periods; runs found again at other lengths are dropped.
    """
    if times < 3:
        raise ValueError(f"runs must have three periods or more, not {times}")
    doc = np.searchsorted(starts, np.arange(len(words)), "right") - 1
    ends = starts[doc + 1]
    places = np.arange(len(words))
    names = _names(words + doc * (int(words.max(initial=0)) + 1))[0] if len(words) else words
    found, size = [], 1
    while len(places):
        # Names sort places by factor; the next occurrence is the next place in that order.
        order = np.argsort(names, kind="stable")
        ordered, at = names[order], places[order]
        same = ordered[1:] == ordered[:-1]
        gap = np.diff(at)
        near = np.flatnonzero(same & (gap <= size))
        if len(near):
            here, d = at[near], gap[near]
            sort = np.argsort(here)
            here, d = here[sort], d[sort]
            begins = np.flatnonzero((np.diff(here, prepend=-2) != 1) | (np.diff(d, prepend=-1) != 0)
                                    | (doc[here] != np.concatenate([[-1], doc[here[:-1]]])))
            lasts = np.append(begins[1:], len(here)) - 1
            found.append(np.stack([here[begins], here[lasts] - here[begins] + d[begins] + size, d[begins]]))
        # Twice the length: both halves must occur again, within the document.
        again = np.zeros(len(words), bool)
        again[at[1:][same]] = True
        again[at[:-1][same]] = True
        name_at = np.full(len(words), -1, np.int64)
        name_at[places] = names
        left = np.flatnonzero(again)
        left = left[left + 2 * size <= ends[left]]
        left = left[again[left + size]]
        keys = name_at[left] * (int(names.max(initial=0)) + 1) + name_at[left + size]
        places, names, size = left, _names(keys)[0] if len(left) else keys, 2 * size
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    long = (length >= least) & (length >= times * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length in periods, then of the smallest start and period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run only its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, words_of: WordsOf = plain_words, least: int = 6, times: int = 4
                  ) -> DataFrame:
    """``doc_id, text_hash, runs, start, length, period, collapsed`` of every row.

    ``runs`` lists start, length and period of every run (see :func:`runs_of`) in
    words, by start and period; ``start, length, period`` are the one that repeats
    most often, or null. ``collapsed`` is the text as words joined by one space,
    where of each run only the first period stays. ``words_of`` makes words of an id and a
    text; words are equal if their bytes are.

    Rows are worked on where they are read, without a shuffle. A document is looked
    at whole by one task, whose memory grows with the document's own words (some
    100 bytes each), and its time by n log n. A null or empty text has no words and no
    run, and its collapsed text is empty. A null ``doc_id`` keeps its row, repeated rows
    each get a row, further columns are left out, and an empty table gives none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        total = 0
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, key, text in zip(ids, keys, batch.column(2)):
                words = words_of(doc_id, text.as_py())
                if rows and total + len(words) > _WORDS:
                    yield judged(rows)
                    rows, total = [], 0
                rows.append((doc_id, key, words))
                total += len(words)
        if rows:
            yield judged(rows)

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        for _, _, words in rows:
            for word in words:
                numbers.setdefault(word, len(numbers))
        starts = np.cumsum([0] + [len(words) for _, _, words in rows])
        flat = np.fromiter((numbers[w] for _, _, words in rows for w in words), np.int64, int(starts[-1]))
        start, length, period = runs_of(flat, starts, least, times)
        cuts = np.searchsorted(start, starts)
        out: list[tuple] = []
        for i, (doc_id, key, words) in enumerate(rows):
            a, b = cuts[i], cuts[i + 1]
            runs = list(zip((start[a:b] - starts[i]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
            listed = [dict(zip(("start", "length", "period"), run)) for run in runs]
            out.append((doc_id, key, listed, *(strongest(runs) or (None, None, None)),
                        collapsed(words, runs)))
        columns = list(zip(*out))
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    rows = documents(docs).select("doc_id", "text_hash", "text")
    return rows.mapInArrow(read, _SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_TYPES = (pa.int64(), pa.int64(), pa.list_(_RUN), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_NAMES = ["doc_id", "text_hash", "runs", "start", "length", "period", "collapsed"]
_SCHEMA = ("doc_id bigint, text_hash bigint, "
           "runs array<struct<start: bigint, length: bigint, period: bigint>>, start bigint, "
           "length bigint, period bigint, collapsed binary")
