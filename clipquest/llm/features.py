"""Labelled samples and hashed sparse features for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquest.llm.rows import NOT_ALPHANUMERIC, documents, mix, text_slices, word_hashes

Rows = list[np.ndarray]


def byte_grams(data: np.ndarray, offsets: np.ndarray, size: int, bits: int) -> Rows:
    """Distinct hashed byte ``size``-grams of each row."""
    out, mark = [], np.zeros(1 << bits, np.int64)
    codes = np.zeros(max(0, len(data) - size + 1), np.uint64)
    for i in range(size):
        codes = (codes << np.uint64(8)) | data[i:i + len(codes)].astype(np.uint64)
    places = (mix(codes + np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out.append(_distinct(places[a:max(a, b - size + 1)], mark))
    return out


def word_grams(data: np.ndarray, offsets: np.ndarray, size: int, bits: int) -> Rows:
    """Distinct hashed word n-grams, n up to ``size``, of each row.

    Words have A-Z lower-cased and end at any ASCII character but letters and digits.
    """
    hashes, starts = word_hashes(data, offsets, NOT_ALPHANUMERIC)
    mark = np.zeros(1 << bits, np.int64)
    grams, total = [], hashes
    for n in range(1, size + 1):
        if n > 1:
            total = mix(total[:-1] + hashes[n - 1:] * np.uint64(2 * n + 1)) if len(total) else total
        grams.append((mix(total + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
    return [_distinct(np.concatenate([g[a:max(a, b - n)] for n, g in enumerate(grams)]), mark)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def repeated_pairs(data: np.ndarray, offsets: np.ndarray, levels: tuple[float, ...], start: int) -> Rows:
    """Indicators, from place ``start`` on, of word pairs "w w" being over a share of a row's pairs."""
    hashes, starts = word_hashes(data, offsets)
    equal = np.concatenate([[0], np.cumsum(hashes[1:] == hashes[:-1])]) if len(hashes) else np.zeros(1)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        share = (equal[b - 1] - equal[a]) / (b - a - 1) if b - a > 1 else 0.0
        out.append(start + np.flatnonzero(share > np.array(levels)))
    return out


def _distinct(places: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Distinct values, by a scatter into ``mark`` instead of a sort."""
    own = np.arange(len(places))
    mark[places] = own
    return places[mark[places] == own]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, train: Column, rows: int
                    ) -> DataFrame:
    """``doc_id, text, text_hash, label`` of at most ``rows`` labelled training documents.

    The sample is the documents whose ids have the lowest hashes, whatever the
    order of rows. Labels that are null, or whose id is, are left out; of several
    labels of an id the largest holds.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), label.alias("label")).filter(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).filter(train)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents(docs).join(F.broadcast(chosen), "doc_id")


def fitted(sample: DataFrame, features: Callable, fit: Callable[[Rows, np.ndarray, np.ndarray], bytes],
           default: bytes) -> bytes:
    """Hash the sample's texts where they are, bring the features to one task, fit there.

    ``fit`` gets rows sorted by id and text hash, their labels and their order
    numbers, so the result does not depend on how rows were dealt.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                found = [f.astype("<i4").tobytes() for f in features(data, offsets)]
                yield pa.record_batch([part.column(0), part.column(2), part.column(3),
                                       pa.array(found, pa.binary())],
                                      ["doc_id", "text_hash", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            # Views of Arrow's memory, which is given back whole; small copies would leave holes in the worker's.
            rows += [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(3)]
            labels += batch.column(2).to_pylist()
        if rows:
            yield pa.record_batch([pa.array([fit(rows, np.array(labels))], pa.binary())], ["model"])

    sparse = sample.select("doc_id", "text", "text_hash", F.col("label").cast("int")).mapInArrow(
        hashed, "doc_id bigint, text_hash bigint, label int, features binary")
    found = sparse.repartition(1).sortWithinPartitions("doc_id", "text_hash").mapInArrow(
        learn, "model binary").collect()
    return bytes(found[0].model) if found else default
