"""Every corpus query over the smallest given tables: its contract's columns, and its SQL."""

import os

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, connection
from clipquest.llm.oracles import all_oracles
from clipquest.llm.queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")

COLUMNS = {
    "op1_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                      "base_score double, score double",
    "op2_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
                         "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_toxicity": "doc_id bigint, held_out boolean, expected_severity double, score double, predicted int",
    "op8_decontamination": "doc_id bigint, item_id bigint, overlap bigint, equal bigint",
    "op9_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                 "refers_to bigint",
    "op11_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                         "spans string",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, "
                          "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}
# Queries with rows of their own, not one per row of their table.
OTHER_ROWS = ("op8_decontamination", "op13_ranked_search")


def test_all_are_registered():
    assert set(COLUMNS) == set(all_queries())
    assert {*COLUMNS, "pipeline"} <= set(entry_points.queries())
    assert set(all_oracles()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    found = all_queries()[name](spark, SF_DIR)
    assert set(COLUMNS[name].split(", ")) <= {" ".join(c) for c in found.dtypes}
    given = "pages" if name == "op10_warc" else "documents"
    rows = spark.read.parquet(f"{SF_DIR}/{given}.parquet").count()
    assert found.count() == rows or name in OTHER_ROWS


@pytest.mark.parametrize("name", list(all_oracles()))
def test_sql(spark, name):
    count, problems = compare(spark, connection(SF_DIR), SF_DIR, all_queries()[name], all_oracles()[name])
    assert count and not problems
