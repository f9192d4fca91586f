"""Lines that many documents share, dropped from all documents but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquest.llm.rows import SPACES, documents, free_names
from clipquest.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc, text_hash, pos, h1, h2`` of each line whose key has ``min_chars`` code points.

    Two 64-bit hashes stand for a key. A null id becomes the lowest number.
    """
    rows = documents(docs)
    lines = rows.select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "text_hash",
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # Keys have as many characters as trimmed lines, so short lines go before the costly step.
    long = lines.filter(F.char_length(F.btrim("line", F.lit(SPACES))) >= min_chars)
    return long.select("doc", "text_hash", "pos", F.xxhash64(line_key(F.col("line"))).alias("h1"),
                       F.xxhash64(F.lit(1), line_key(F.col("line"))).alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc, text_hash, ends, runs`` of each row that loses lines.

    ``runs`` is the row's keep bitmap in compressed form: lengths of runs of
    lines, in turn kept and dropped, first kept; what follows the last run is
    kept. ``ends`` says where they end, so that a run can be cut out by itself. A key of at least ``min_chars`` code points found in ``min_docs``
    documents or more is dropped everywhere but in the document of the largest
    id that holds it. Documents are told apart by id; null ids are one document,
    below all others. Repeated rows lose the same lines.

    Hashes are range-partitioned by key and document, so one key's lines may
    spread over many partitions, and sorted there by key, document and position.
    A window streams over them, without a further shuffle, and passes on the first
    occurrence of a key in each document. Counts and
    largest documents of keys are added up before they are shuffled, so hot keys
    are cheap; the join back splits hot keys when it runs (AQE).
    """
    lines = materialize(line_hashes(docs, min_chars), "lines")
    ranged = lines.repartitionByRange("h1", "h2", "doc")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "doc").orderBy("pos"))
    first = ranged.withColumn("place", place).filter("place = 1")
    keys = first.groupBy("h1", "h2").agg(
        F.count("*").alias("docs"), F.max("doc").alias("keeper")).filter(F.col("docs") >= min_docs)
    # Written first: AQE splits hot keys only where both sides come right from a shuffle.
    keys = materialize(keys.select("h1", "h2", "keeper"), "shared-lines")
    dropped = lines.join(keys, ["h1", "h2"]).filter("doc < keeper")
    bits = dropped.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    bits = bits.select("doc", "text_hash", _ends(F.col("gone")).alias("ends"))
    ends = F.col("ends")
    return bits.select("doc", "text_hash", "ends", F.transform(
        ends, lambda e, i: e - F.when(i == 0, 0).otherwise(F.get(ends, i - 1))).alias("runs"))


def _ends(gone: Column) -> Column:
    """Where runs of kept and of dropped lines end, of a sorted list of dropped positions."""
    # Starts and ends of runs: positions whose neighbour before or after stays.
    size = F.size(gone)
    starts = F.filter(gone, lambda p, i: (i == 0) | (F.get(gone, i - 1) != p - 1))
    ends = F.filter(gone, lambda p, i: (i == size - 1) | (F.get(gone, i + 1) != p + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` and ``more`` columns of ``docs``, lines dropped.

    Only this step moves texts, once, and rows without a bitmap stay as they are.
    Its work grows with a text's lines and not with their square. A null or empty text is one
    empty line. ``more`` may have any names but those four.
    """
    doc, edges, split = free_names(docs, "doc", "ends", "lines")
    rows = documents(docs, *more).withColumn(doc, F.coalesce("doc_id", F.lit(_NO_ID)))
    bits = bitmaps.select(F.col("doc").alias(doc), "text_hash", F.col("ends").alias(edges))
    joined = rows.join(bits.hint("shuffle_hash"), [doc, "text_hash"], "left")
    # A column of its own, used more than once, so it is split once and not for each run.
    joined = joined.withColumn(split, F.split("text", "\n", -1))
    lines, ends = F.col(split), F.col(edges)

    def kept_run(k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get(ends, 2 * k - 1))
        end = F.coalesce(F.get(ends, 2 * k), F.size(lines))
        return F.slice(lines, begin + 1, end - begin)

    # Every other edge ends dropped lines, the others begin them.
    gone = F.aggregate(F.transform(ends, lambda e, i: F.when(i % 2 == 1, e).otherwise(-e)), F.lit(0),
                       lambda a, x: a + x)
    kept = F.array_join(F.flatten(F.transform(
        F.sequence(F.lit(0), F.expr(f"size(`{edges}`) div 2").cast("int")), kept_run)), "\n")
    return joined.select(
        "doc_id", F.when(ends.isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.when(ends.isNull(), 0).otherwise(gone).cast("bigint").alias("n_dropped"), *more)


def drop_shared_lines(docs: DataFrame, *more: str, min_chars: int = 40, min_docs: int = 5
                      ) -> DataFrame:
    """Drop shared lines from documents; see :func:`keep_bitmaps`.

    Further columns are left out unless named; an empty table gives no row. A
    very long text is many lines like any other, and a very long line two hashes.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), *more)
