"""Token counts of documents, from piece counts of distinct pre-tokens."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.llm.rows import documents, most_frequent, per_copy, word_counts
from clipquest.session import materialize

# A pre-token ends before a space that follows something else, and around a line
# break, which no piece holds. No merge of the model crosses such a place.
_PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text; the model puts a space first and reads U+2581 as a space."""
    return _PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


def _check_pieces(processor) -> None:
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    for number, piece in enumerate(pieces):
        if "\n" in piece or re.search("[^▁]▁", piece):
            raise ValueError(f"piece {number} crosses a pre-token's end: {piece!r}")


@functools.lru_cache(maxsize=2)
def _processor(model: bytes):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    _check_pieces(processor)
    return processor


def piece_counts(words: DataFrame, model: bytes) -> DataFrame:
    """``word``, ``n`` and ``pieces``: how many tokens each distinct pre-token has."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model)
        for batch in batches:
            # After a line break no space is added; the break itself and the space
            # before it are two tokens.
            ids = processor.encode(["\n" + w.as_py() for w in batch.column(0)], num_threads=1)
            yield pa.record_batch([batch.column(0), batch.column(1),
                                   pa.array([len(x) - 2 for x in ids], pa.int64())],
                                  ["word", "n", "pieces"])

    return words.mapInArrow(encode, "word string, n bigint, pieces bigint")


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, frequent: int = 131_072
                 ) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text under a piece model.

    Each distinct pre-token is encoded once. The ``frequent`` most frequent ones
    (a fixed number) are looked up from a broadcast table where documents are
    read, which also takes all hot keys out of the shuffle; the frequencies of the
    others are joined. No ids are ever built for a document.

    A null or empty text has no tokens. A null ``doc_id`` keeps its row; repeated
    rows each get a row; further columns are ignored; an empty table gives none.
    """
    spark, rows = docs.sparkSession, documents(docs)
    words = materialize(piece_counts(word_counts(rows, pre_tokens, "string"), model), "pieces")
    head = most_frequent(words, frequent).select("word", "pieces").toArrow()
    known = dict(zip(head.column(0).to_pylist(), head.column(1).to_pylist()))
    shared = spark.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = batch.column(2).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, text in enumerate(batch.column(3)):
                total, rest = 0, []
                for word, n in Counter(pre_tokens(text.as_py())).items():
                    pieces = table.get(word)
                    if pieces is None:
                        rest.append((word, n))
                    else:
                        total += n * pieces
                mark = f"\n{hashes[row]}"  # two characters or more after a break: no pre-token
                for values, value in zip(out, (ids[row], hashes[row], mark, total, sizes[row])):
                    values.append(value)
                for word, n in rest:
                    for values, value in zip(out, (ids[row], hashes[row], word, n, None)):
                        values.append(value)
                if len(out[0]) > 50_000:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds)], names)
                    out = ([], [], [], [], [])
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds)], names)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["doc_id", "text_hash", "word", "n", "n_bytes"]
    counted = rows.select("doc_id", "text_hash", F.octet_length("text").cast("bigint"), "text"
                          ).mapInArrow(read, "doc_id bigint, text_hash bigint, word string, "
                                             "n bigint, n_bytes bigint")
    joined = counted.join(words.select("word", "pieces"), "word", "left")
    # Equal rows add up equal parts, so the sum over the copies is a multiple.
    tokens = F.sum(F.col("n") * F.coalesce("pieces", F.lit(1)))
    found = joined.groupBy("doc_id", "text_hash").agg(
        tokens.alias("tokens"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("copies"))
    n_tokens = F.expr("tokens div copies")
    return per_copy(
        found.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"),
                     (n_tokens > limit).alias("over_limit"), "copies"), "copies")
