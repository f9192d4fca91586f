"""A training corpus from ``documents``: good texts, without shared lines, near copies and
benchmark passages, as token ids."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquest.llm import bpe, decontamination, jaccard_join, line_dedup, quality_classifier
from clipquest.session import materialize, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RANKS = "byte_bpe_50k.tiktoken"
# Near copies of the corpus; the query op9_ngram_jaccard has its own parameters.
NEAR = jaccard_join.Similarity(words=5, percent=80)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_classifier.keep_good(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others hold too; ``n_chars`` follows the text."""
    ship_package(spark)
    kept = line_dedup.drop_shared_lines(docs, "lang", "source")
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 80 %."""
    ship_package(spark)
    return jaccard_join.keep_one_each(docs, NEAR).select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of the remaining documents, and digests of ids and decoded bytes."""
    import public_tokenizers

    ship_package(spark)
    ranks = Path(public_tokenizers.path(RANKS)).read_bytes()
    # Written first, so that a task has one Python worker and not two: executors keep idle workers' memory.
    encoded = materialize(bpe.encode(docs, ranks, public_tokenizers.PATTERN), "encoded")
    return bpe.decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("good_texts", good_texts),
    ("own_lines", own_lines),
    ("one_of_each", one_of_each),
    ("without_benchmarks", without_benchmarks),
    ("token_ids", token_ids),
]

# The quality classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
