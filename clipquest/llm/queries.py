"""One query per corpus operator, over the whole of its table."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquest.llm import (
    bpe, decontamination, jaccard_join, lexical_search, line_dedup, lm_scoring, periodic_runs,
    quality_classifier, quality_rules, secret_scans, toxicity, warc)
from clipquest.llm import token_counts as counts
from clipquest.session import scratch_dir, ship_package

PIECE_MODEL, BYTE_RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"

_QUERIES = {}


def query(function):
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_file(name: str) -> bytes:
    """A tokenizer file, read once on the driver; under 2 MB."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


@query
def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


@query
def op2_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op3_token_counts(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), public_file(PIECE_MODEL))


@query
def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge_documents(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op5_quality_classifier(spark, sf_dir):
    scored = quality_classifier.quality_scores(table(spark, sf_dir, "documents"),
                                               table(spark, sf_dir, "labels"))
    return scored.drop("text_hash")


@query
def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    ranks = public_file(BYTE_RANKS)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_toxicity(spark, sf_dir):
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop(
        "text_hash")


@query
def op8_decontamination(spark, sf_dir):
    found = decontamination.find_passages(table(spark, sf_dir, "documents"),
                                          table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query
def op9_ngram_jaccard(spark, sf_dir):
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents")).drop(
        "text_hash", "group")


@query
def op10_warc(spark, sf_dir):
    target = f"{scratch_dir(spark)}/clipquest/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), target)
    return warc.read_archives(spark, target).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_secret_scans(spark, sf_dir):
    spans = secret_scans.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return spans.select("doc_id", counted("assign"), counted("access"), counted("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op12_periodic_runs(spark, sf_dir):
    runs = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.repeated_tail)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return runs.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "start", "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_ranked_search(spark, sf_dir):
    return lexical_search.ranked_documents(table(spark, sf_dir, "documents"),
                                           table(spark, sf_dir, "benchmark")).drop("text_hash")
