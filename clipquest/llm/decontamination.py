"""Benchmark passages in documents, found by spaced seeds and checked around each hit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.llm.rows import documents, free_names, mix, text_slices, word_hashes
from clipquest.session import materialize


# Items of fewer tokens may not differ at all.
_WHOLE = 5


@dataclass(frozen=True)
class SpacedSeeds:
    """Masks say which of consecutive tokens count (1) and which may differ (0).

    A passage counts as found where aligned tokens overlap over at least
    ``min_overlap`` tokens (or a whole shorter item) and ``percent`` % of them are
    equal. ``filter_bits`` is the size of the broadcast filter, ``around`` how
    many tokens before and after a hit are checked.

    At 80 % some of ``masks`` fits into every passage of 13 to 25 tokens, wherever
    its unequal ones are, and a longer passage can be cut into such lengths, one of
    which has 80 % equal too. ``short_masks`` do the same for whole items of 5 to 12
    tokens. Still shorter ones are searched for by all their tokens, and items of
    fewer than ``shortest`` tokens not at all.
    """

    masks: tuple[str, ...] = ("11101111", "11010010111", "111110011", "1100100010111",
                              "1110101001001", "1111111")
    short_masks: tuple[str, ...] = ("11011", "10111", "11101", "1111")
    min_overlap: int = 13
    percent: int = 80
    around: int = 64
    filter_bits: int = 1 << 24
    shortest: int = 6

    @property
    def every(self) -> tuple[str, ...]:
        return (*self.masks, *self.short_masks, *("1" * n for n in range(1, _WHOLE)))

    def numbers(self, size: int) -> list[int]:
        """Which of ``every`` are for an item of ``size`` tokens."""
        short, whole = len(self.masks), len(self.masks) + len(self.short_masks)
        if size < self.shortest or not size:
            return []
        if size >= self.min_overlap:
            return list(range(short))
        return list(range(short, whole)) if size >= _WHOLE else [whole + size - 1]


_PAGE = 1 << 15
_ODD = (mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1))


def seeds_at(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The seed hash of each place where the whole mask fits."""
    size = len(hashes) - len(mask) + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(size, number + 1, np.uint64)
    for place, used in enumerate(mask):
        if used == "1":
            total += hashes[place:place + size] * _ODD[place]
    return mix(total)


def filter_places(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each seed in a filter."""
    return (seeds & np.uint64(bits - 1)).astype(np.int64), (
        (seeds >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def benchmark_seeds(benchmark: DataFrame, config: SpacedSeeds) -> DataFrame:
    """``item_id, text_hash, tokens, seeds, places`` of each item with enough tokens.

    A seed that an item repeats is listed with each of its places.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                hashes, starts = word_hashes(data, offsets)
                ids, keys = part.column(0).to_pylist(), part.column(2).to_pylist()
                out: list[list] = [[], [], [], [], []]
                for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                    own = hashes[a:b]
                    seeds = [seeds_at(own, config.every[n], n) for n in config.numbers(len(own))]
                    if not seeds:
                        continue
                    places = np.concatenate([np.arange(len(s)) for s in seeds])
                    if len(places):
                        for column, value in zip(out, (ids[i], keys[i], own.tobytes(),
                                                       np.concatenate(seeds).view(np.int64), places)):
                            column.append(value)
                yield pa.record_batch(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                     pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64())),
                     pa.array(out[4], pa.list_(pa.int32()))],
                    ["item_id", "text_hash", "tokens", "seeds", "places"])

    items = documents(benchmark.withColumnRenamed("item_id", "doc_id"))
    return items.mapInArrow(read, "item_id bigint, text_hash bigint, tokens binary, "
                                  "seeds array<bigint>, places array<int>")


def seed_filter(items: DataFrame, bits: int) -> np.ndarray:
    """A bit array of fixed size that has the two bits of every item seed."""
    seed = items.select(F.explode("seeds").alias("seed"))
    both = seed.select(F.explode(F.array(
        F.col("seed").bitwiseAND(F.lit(bits - 1)),
        F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(bits - 1)))).alias("bit"))
    pages = both.groupBy(F.floor(F.col("bit") / _PAGE).alias("page")).agg(
        F.bitmap_construct_agg(F.col("bit") % _PAGE).alias("bits")).collect()
    out = np.zeros(bits, bool)
    for row in pages:
        found = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little").astype(bool)
        out[row.page * _PAGE:(row.page + 1) * _PAGE] |= found
    return np.packbits(out)


def masks_of(items: DataFrame, config: SpacedSeeds) -> list[int]:
    """Numbers of the masks that the items' lengths call for; at most ``min_overlap`` rows are read."""
    size = F.least(F.octet_length("tokens") / 8, F.lit(config.min_overlap)).cast("int")
    sizes = [row["size"] for row in items.select(size.alias("size")).distinct().collect()]
    return sorted({n for size in sizes for n in config.numbers(size)})


def document_hits(docs: DataFrame, filtered: np.ndarray, numbers: list[int], config: SpacedSeeds
                  ) -> DataFrame:
    """Stretches of documents around seeds, of the masks ``numbers``, that pass the filter.

    ``doc_id, text_hash, start, tokens, seeds, places``: the token hashes from
    ``start`` on, and the seeds with their places in the document. Hits whose
    surroundings meet share a stretch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filtered)
    masks = [(n, config.every[n]) for n in numbers]
    widest = max((len(m) for _, m in masks), default=0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                hashes, starts = word_hashes(data, offsets)
                where, what = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for number, mask in masks:
                    seeds = seeds_at(hashes, mask, number)
                    one, two = filter_places(seeds, config.filter_bits)
                    hit = np.flatnonzero(table[one])
                    hit = hit[table[two[hit]]]
                    # A mask must not reach into the next row.
                    row = np.searchsorted(starts, hit, "right") - 1
                    hit = hit[hit + len(mask) <= starts[row + 1]]
                    where.append(hit)
                    what.append(seeds[hit])
                places, values = np.concatenate(where), np.concatenate(what)
                if not len(places):
                    continue
                order = np.argsort(places, kind="stable")
                places, values = places[order], values[order]
                row = np.searchsorted(starts, places, "right") - 1
                gap = 2 * config.around + widest
                cut = np.flatnonzero((np.diff(row, prepend=-1) != 0)
                                     | (np.diff(places, prepend=-gap - 1) > gap))
                ids, keys = part.column(0).to_pylist(), part.column(2).to_pylist()
                out: list[list] = [[], [], [], [], [], []]
                for a, b in zip(cut, np.append(cut[1:], len(places))):
                    r = int(row[a])
                    low = max(int(starts[r]), int(places[a]) - config.around)
                    high = min(int(starts[r + 1]), int(places[b - 1]) + widest + config.around)
                    for column, value in zip(out, (
                            ids[r], keys[r], low - int(starts[r]), hashes[low:high].tobytes(),
                            values[a:b].view(np.int64), places[a:b] - starts[r])):
                        column.append(value)
                yield pa.record_batch(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                     pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()),
                     pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "start", "tokens", "seeds", "places"])

    return documents(docs).mapInArrow(
        read, "doc_id bigint, text_hash bigint, start bigint, tokens binary, "
              "seeds array<bigint>, places array<bigint>")


def best_overlap(equal: np.ndarray, percent: int) -> tuple[int, int, int]:
    """Start, length and equal tokens of the longest stretch with ``percent`` % of equal ones.

    An equal token scores ``100 - percent`` and another ``-percent``, so such a
    stretch scores 0 or more. Only stretches that begin and end at equal tokens count.
    """
    if not equal.any():
        return 0, 0, 0
    score = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    ends = np.flatnonzero(equal) + 1
    # For each end the first equal token before which no more has been scored.
    least = np.minimum.accumulate(np.where(equal, score[:-1], np.iinfo(np.int64).max))
    starts = np.searchsorted(-least, -score[ends], "left")
    best = int(np.argmax(ends - starts))
    start, end = int(starts[best]), int(ends[best])
    return start, end - start, int(equal[start:end].sum())


def find_passages(docs: DataFrame, benchmark: DataFrame, config: SpacedSeeds = SpacedSeeds()
                  ) -> DataFrame:
    """``doc_id, text_hash, item_id, start, overlap, equal``: items found in documents.

    One row per document row and item: the longest overlap found, its first token
    in the document, and how many of its tokens are equal. Tokens are words with
    A-Z lower-cased.

    Seeds of the corpus meet a bit filter of fixed size that holds the benchmark's
    seeds; a larger benchmark only lets more through. What passes is joined with
    the benchmark's seeds by hash, each alignment once, and checked token by token.

    Every place of a seed in an item meets every place of it in a document, so
    repeats inside an item hide no alignment; equal alignments count once before
    they are shuffled.

    Null or empty texts hold nothing and are not found; items of fewer than
    ``shortest`` tokens are not searched for. A very long text is searched whole, and what goes on
    are the stretches around its hits. With no documents or no items nothing is found. Null ids are kept as they are. Repeated
    rows count once; further columns are ignored.
    """
    items = materialize(benchmark_seeds(benchmark, config), "items")
    filtered = seed_filter(items, config.filter_bits)
    hits = materialize(document_hits(docs, filtered, masks_of(items, config), config), "hits")
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")
    stretch = hits.select(key, "doc_id", "text_hash", "start", "tokens")
    corpus = hits.select(key, "text_hash", "start", F.explode(F.arrays_zip("seeds", "places")).alias("s")
                         ).select("doc", "text_hash", "start", "s.seeds", "s.places")
    wanted = items.select(F.struct("item_id", "text_hash").alias("item"),
                          F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "item", "s.seeds", F.col("s.places").alias("at"))
    aligned = corpus.join(wanted, "seeds").select(
        "doc", "text_hash", "start", "item", (F.col("places") - F.col("at")).alias("offset")).distinct()
    passages = items.select(F.struct("item_id", "text_hash").alias("item"),
                            F.col("tokens").alias("item_tokens")).distinct()
    both = aligned.join(stretch, ["doc", "text_hash", "start"]).join(passages, "item")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, key, item, start, offset, text, wanted in zip(
                    *(c.to_pylist() for c in batch.columns)):
                tokens, passage = np.frombuffer(text, np.uint64), np.frombuffer(wanted, np.uint64)
                shift = offset - start
                low, high = max(0, shift), min(len(tokens), shift + len(passage))
                begin, size, equal = best_overlap(
                    tokens[low:high] == passage[low - shift:high - shift], config.percent)
                if size >= min(config.min_overlap, len(passage)):
                    for column, value in zip(out, (doc, key, item, start + low + begin, size, equal)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out],
                                  ["doc_id", "text_hash", "item_id", "start", "overlap", "equal"])

    checked = both.select("doc_id", "text_hash", "item.item_id", "start", "offset", "tokens",
                          "item_tokens").mapInArrow(
        check, "doc_id bigint, text_hash bigint, item_id bigint, start bigint, overlap bigint, "
               "equal bigint")
    best = F.max(F.struct("overlap", "equal", (-F.col("start")).alias("before"))).alias("best")
    return checked.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", (-F.col("best.before")).alias("start"), "best.overlap",
        "best.equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, config: SpacedSeeds = SpacedSeeds()
                      ) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no passage of the benchmark.

    See :func:`find_passages`. Null and empty texts stay, repeated rows go or stay
    together, columns of any name stay as they are, and empty tables are fine on either side.
    """
    own = free_names(docs, "doc", "text")
    key, text = F.coalesce("doc_id", F.lit(-(1 << 63))), F.coalesce("text", F.lit(""))
    found = find_passages(docs, benchmark, config).select(key, "text_hash").toDF(*own).distinct()
    marked = docs.withColumns(dict(zip(own, (key, F.xxhash64(text)))))
    return marked.join(found.hint("shuffle_hash"), own, "left_anti").drop(*own)
