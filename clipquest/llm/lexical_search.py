"""The best documents for each item, by exact term scores behind bit-sliced Bloom signatures."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipquest.llm.rows import NOT_ALPHANUMERIC, documents, mix, text_slices, word_hashes
from clipquest.session import scratch_dir


@dataclass(frozen=True)
class Index:
    """How documents are laid out in a signature index.

    A block holds up to ``columns`` documents of about equal numbers of distinct terms.
    Each sets ``probes`` bits per term, in a signature of ``bits`` bits per entry of the
    block's largest document; a term that a document holds ``levels[i]`` times or more has an
    entry for each of those levels, and is taken to occur ``levels[i + 1] - 1`` times at most
    where the next level's entry is missing. ``block_bits`` bounds a block's slices, and ``group`` the
    term entries that a task sorts into blocks together.
    """

    columns: int = 512
    bits: int = 10
    probes: int = 4
    levels: tuple[int, ...] = (1, 2, 4)
    block_bits: int = 1 << 23
    group: int = 1 << 20


@dataclass(frozen=True)
class Ranking:
    """The score of a term in a document: ``weight * (scale * tf div (1000 * tf + norm * m))``.

    ``m`` is ``100 - share + (share * n * N) div L`` for a document of n terms among N
    documents of L terms; the weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``.
    """

    share: int = 90
    scale: int = 1_000_000_000
    norm: int = 8

    def lengths(self, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
        # Python integers: the product may pass 64 bits for very long texts.
        return np.array([100 - self.share + self.share * int(x) * documents // max(1, terms) for x in n],
                        np.int64)

    def factor(self, tf, m):
        return self.scale * tf // (1000 * tf + self.norm * m)

    def weight(self, df: int, documents: int) -> int:
        return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                   0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9],
                  np.uint64)


def places(terms: np.ndarray, level: int, width: int, probes: int) -> np.ndarray:
    """The slices (rows of bits) that an entry sets, one column per probe."""
    seeds = _SALTS[:probes] + np.uint64(level + 1)
    return (mix(terms[:, None] ^ seeds[None, :]) % np.uint64(width)).astype(np.int64)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Row numbers, distinct term hashes (sorted) and their counts, of each document."""
    for part, data, offsets in text_slices(batch):
        hashes, starts = word_hashes(data, offsets, NOT_ALPHANUMERIC)
        ids = part.column(0).to_pylist()
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            terms, counts = np.unique(hashes[a:b], return_counts=True)
            yield ids[i], terms, counts.astype(np.uint32)


def _entries(counts: np.ndarray, levels: tuple[int, ...]) -> int:
    return int(sum((counts >= level).sum() for level in levels))


def block_row(rows: list[tuple], index: Index) -> tuple:
    """One block: ids, vectors and the slices, eight documents to a byte.

    ``rows`` are (id, terms, counts) of documents.
    """
    sizes = [_entries(counts, index.levels) for _, _, counts in rows]
    width = max(64, index.bits * max(sizes))
    bits = np.zeros((width, -(-len(rows) // 8)), np.uint8)
    for column, (_, terms, counts) in enumerate(rows):
        for level, least in enumerate(index.levels):
            held = terms[counts >= least]
            bits[places(held, level, width, index.probes).ravel(), column // 8] |= 128 >> column % 8
    return ([r[0] for r in rows], [len(r[1]) for r in rows], [int(r[2].sum()) for r in rows],
            np.concatenate([r[1] for r in rows]).tobytes(), np.concatenate([r[2] for r in rows]).tobytes(),
            width, bits.tobytes())


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                    ("lengths", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()),
                    ("width", pa.int64()), ("slices", pa.binary())])
_BLOCK_SQL = ("ids array<bigint>, sizes array<int>, lengths array<bigint>, terms binary, counts binary, "
              "width bigint, slices binary")


def build_index(docs: DataFrame, path: str, index: Index = Index()) -> DataFrame:
    """Write a signature index of all documents that hold a term, and read it back.

    A row is a block: ``ids``, how many distinct and how many terms each document has,
    the documents' term hashes (sorted) and counts, and the bit slices. Blocks
    are cut where the documents are read, without a shuffle. Terms are maximal stretches
    of ASCII letters and digits and other characters beyond ASCII, A-Z lower-cased; 64-bit
    hashes stand for them. Row groups are small, so that a reader holds few blocks at once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for batch in batches:
            for row in _vectors(batch):
                if not len(row[1]):
                    continue
                held.append(row)
                total += len(row[1])
                if total >= index.group:
                    yield from blocks(held)
                    held, total = [], 0
        yield from blocks(held)

    def blocks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: len(r[1]), reverse=True)
        start = 0
        while start < len(held):
            widest = index.bits * _entries(held[start][2], index.levels)
            fit = max(1, min(index.columns, index.block_bits // max(64, widest)))
            block = block_row(held[start:start + fit], index)
            yield pa.record_batch([pa.array([v], t) for v, t in zip(block, _BLOCK.types)], _BLOCK.names)
            start += fit

    rows = documents(docs).select("doc_id", "text")
    texts = rows.select("doc_id", F.lit(0).alias("_"), "text")
    texts.mapInArrow(read, _BLOCK_SQL).write.mode("errorifexists").option(
        "parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(_BLOCK_SQL).parquet(path)


@dataclass
class _Items:
    """Items of one job: the distinct terms of all, and where each item's are among them."""

    keys: list[tuple]
    terms: np.ndarray
    which: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> _Items:
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        terms, which = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        return cls([tuple(r[:2]) for r in rows], terms, which, np.cumsum([0] + [len(s) for s in sets]))


def item_terms(items: DataFrame) -> DataFrame:
    """``doc_id, text_hash, terms, size``: the distinct term hashes of each item that has any."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, terms) for i, (_, terms, _) in enumerate(_vectors(batch)) if len(terms)]
            kept = batch.take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.record_batch(
                [kept.column(0), kept.column(1), pa.array([t.tobytes() for _, t in found], pa.binary()),
                 pa.array([len(t) for _, t in found], pa.int64())], ["doc_id", "text_hash", "terms", "size"])

    rows = documents(items).select("doc_id", "text_hash", "text").distinct()
    return rows.mapInArrow(read, "doc_id bigint, text_hash bigint, terms binary, size bigint")


def collection(blocks: DataFrame) -> tuple[int, int]:
    """How many documents hold a term, and how many terms they hold together."""
    sizes = blocks.select(F.size("ids").cast("bigint").alias("n"),
                          F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("l"))
    row = sizes.agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return row.n or 0, row.l or 0


def term_documents(blocks: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the (sorted, distinct) terms occurs, counted exactly."""
    shared = blocks.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        totals = np.zeros(len(wanted) + 1, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                held = np.frombuffer(batch.column(0)[row].as_buffer(), np.uint64)
                at = np.searchsorted(wanted, held)
                at[at == len(wanted)] = 0
                totals += np.bincount(at[wanted[at] == held], minlength=len(totals))
        found = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(found), pa.array(totals[found])], ["term", "n"])

    if not len(terms):
        return np.zeros(0, np.int64)
    rows = blocks.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


class _Best:
    """The best documents of one item in a task so far."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    @property
    def least(self) -> int:
        """A document below this score is not among the best."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, score: int, doc_id: int | None) -> None:
        # Scores fall, then ids rise, and null comes last.
        self.rows.append((-score, doc_id is None, doc_id or 0))
        self.rows.sort()
        del self.rows[self.top:]


def upper_bounds(slices: np.ndarray, n: np.ndarray, m: np.ndarray, items: _Items, weights: np.ndarray,
                 index: Index, ranking: Ranking) -> np.ndarray:
    """For each item and document of a block a score that the document's own can't pass.

    ``slices`` has a row of bits per place; the slices of an entry's places, taken together,
    show all documents that hold it, and some more. Per level the weights of an item's
    terms are summed over what their slices show, and a level adds what a term gains there.
    """
    width, out = len(slices), np.zeros((len(items.keys), len(n)), np.int64)
    step = max(1, (1 << 21) // max(1, len(n)))
    before = np.zeros(len(n), np.int64)
    held = None
    for level in range(len(index.levels)):
        top = index.levels[level + 1] - 1 if level + 1 < len(index.levels) else n
        factor = ranking.factor(np.minimum(top, n), m)
        gain, before = factor - before, factor
        packed = np.bitwise_and.reduce(slices[places(items.terms, level, width, index.probes)], axis=1)
        # Without the entry of a lower level there is none of this one.
        held = packed if held is None else held & packed
        first = 0
        while first < len(items.keys):
            last = max(first + 1, int(np.searchsorted(items.starts, items.starts[first] + step, "right")) - 1)
            last = min(last, len(items.keys))
            which = items.which[items.starts[first]:items.starts[last]]
            bits = np.unpackbits(held[which], axis=1, count=len(n))
            sums = np.add.reduceat(bits * weights[which][:, None], items.starts[first:last] - items.starts[first],
                                   axis=0)
            out[first:last] += sums * gain
            first = last
    return out


def search_blocks(blocks: DataFrame, items: _Items, weights: np.ndarray, documents: int, terms: int,
                  top: int, index: Index, ranking: Ranking) -> DataFrame:
    """``item, text_hash, doc_id, score``: the best of each task for each item, exactly scored."""
    shared = blocks.sparkSession.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [_Best(top) for _ in items.keys]
        for batch in batches:
            for row in range(batch.num_rows):
                block(batch.slice(row, 1), items, weights, best)
        out = [(*key, None if none else doc_id, -score) for key, b in zip(items.keys, best)
               for score, none, doc_id in b.rows]
        columns = list(zip(*out)) or [()] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns],
                              ["item_id", "text_hash", "doc_id", "score"])

    def block(row: pa.RecordBatch, items: _Items, weights: np.ndarray, best: list[_Best]) -> None:
        ids, sizes, n = (row.column(i)[0].as_py() for i in range(3))
        held, counts = (np.frombuffer(row.column(i)[0].as_buffer(), t) for i, t in ((3, np.uint64), (4, np.uint32)))
        slices = np.frombuffer(row.column(6)[0].as_buffer(), np.uint8).reshape(row.column(5)[0].as_py(), -1)
        n = np.array(n, np.int64)
        m = ranking.lengths(n, documents, terms)
        bounds = upper_bounds(slices, n, m, items, weights, index, ranking)
        starts = np.cumsum([0] + sizes)
        for i in np.flatnonzero((bounds >= np.array([b.least for b in best])[:, None]).any(axis=1)).tolist():
            which = items.which[items.starts[i]:items.starts[i + 1]]
            wanted, weight, own = items.terms[which], weights[which], bounds[i]
            open_rows = np.flatnonzero(own >= best[i].least)
            # The most promising first; the others are excluded as soon as the best are better.
            for d in open_rows[np.argsort(-own[open_rows], kind="stable")].tolist():
                if own[d] < best[i].least:
                    break
                terms_here = held[starts[d]:starts[d + 1]]
                at = np.minimum(np.searchsorted(terms_here, wanted), len(terms_here) - 1)
                hit = terms_here[at] == wanted
                tf = counts[starts[d]:starts[d + 1]][at[hit]].astype(np.int64)
                score = int((weight[hit] * ranking.factor(tf, m[d])).sum())
                if score >= best[i].least:
                    best[i].add(score, ids[d])

    return blocks.mapInArrow(search, "item_id bigint, text_hash bigint, doc_id bigint, score bigint")


def _best_of(found: DataFrame, top: int) -> DataFrame:
    """Ranks of the best of all tasks; in two steps, so no task meets what all tasks found for an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.spark_partition_id() % 64)
    part = Window.partitionBy("item_id", "text_hash", "salt").orderBy(*order)
    some = salted.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top)
    whole = Window.partitionBy("item_id", "text_hash").orderBy(*order)
    return some.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top).select(
        "item_id", "text_hash", "rank", "doc_id", "score")


def search(blocks: DataFrame, items: DataFrame, top: int = 10, index: Index = Index(),
           ranking: Ranking = Ranking(), terms_at_once: int = 200_000) -> DataFrame:
    """``item_id, text_hash, rank, doc_id, score``: the ``top`` best documents of each item.

    ``blocks`` is a stored index and ``items`` a table of queries, ``doc_id, text``. Scores (see
    :class:`Ranking`) are exact whole numbers above 0; equal ones rank by ascending
    id, null ids last. An item without terms, or without a document that holds
    one of them, has no row. Repeated items count once, and equal ids with different texts apart.

    Items are searched for in jobs of at most some ``terms_at_once`` terms (an item of more is a
    job of its own), so what is broadcast is bounded. Each job counts exactly in how many documents its
    terms occur, and then reads the index once: a block's slices give every document an upper bound, and
    all documents that their bound does not exclude are scored from their
    term counts. A task keeps the best ``top`` documents it has seen of each item, and excludes
    only what is below them; the best of all tasks are put together in two steps.
    """
    spark = blocks.sparkSession
    counted = item_terms(items).persist()
    try:
        jobs = -(-(counted.agg(F.sum("size")).first()[0] or 0) // terms_at_once)
        found = None
        documents, terms = collection(blocks)
        for job in range(jobs):
            rows = counted.filter(F.pmod("text_hash", F.lit(jobs)) == job).orderBy("doc_id", "text_hash").collect()
            these = _Items.of([(r.doc_id, r.text_hash, r.terms) for r in rows])
            df = term_documents(blocks, these.terms)
            weights = np.array([ranking.weight(int(x), documents) for x in df], np.int64)
            part = _best_of(search_blocks(blocks, these, weights, documents, terms, top, index, ranking), top)
            found = part if found is None else found.unionByName(part)
    finally:
        counted.unpersist()
    return found if found is not None else spark.createDataFrame(
        [], "item_id bigint, text_hash bigint, rank int, doc_id bigint, score bigint")


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = 10, index: Index = Index(),
                     ranking: Ranking = Ranking()) -> DataFrame:
    """Index ``docs`` in the shared folder and :func:`search` it for ``items`` (``item_id, text``).

    Null and empty texts, and those without terms, are no documents. A null ``doc_id`` keeps
    its row, and each of several equal rows is ranked. A text of any length is indexed
    whole, in a block of few documents. Further columns of both tables are left out,
    and an empty table on either side gives no row.
    """
    spark: SparkSession = docs.sparkSession
    path = f"{scratch_dir(spark)}/clipquest/{spark.sparkContext.applicationId}/signatures-{uuid.uuid4().hex}"
    blocks = build_index(docs, path, index)
    return search(blocks, items.select(F.col("item_id").alias("doc_id"), "text"), top, index, ranking)
