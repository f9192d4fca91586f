"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from checks.compare import compare, connection
from checks.queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connection(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) <= set(entry_points.queries())
    assert set(all_queries()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, duck, name):
    rows, problems = compare(spark, duck, SF_DIR, entry_points.queries()[name],
                             entry_points.oracle_sql()[name])
    assert not problems
    assert rows > 0


def test_differences_are_seen(spark, duck):
    query = entry_points.queries()["yes_no_answers"]
    _, problems = compare(spark, duck, SF_DIR, query, entry_points.oracle_sql()["true_false_answers"])
    assert "rows differ" in problems[0]
    sql = entry_points.oracle_sql()["yes_no_answers"] + " WHERE pos > 0"
    assert "rows !=" in compare(spark, duck, SF_DIR, query, sql)[1][0]


def test_entry(spark):
    assert entry_points.entry(spark).limit(5).count() == 5


def test_frames_of_large_splits_are_made_in_many_tasks(spark, tmp_path):
    """One split of narrow rows; a task that gave them their frames would hold them all."""
    from checks.queries import _askable

    events = spark.range(200, numPartitions=1).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "id % 9 AS user_id", "'view' AS event_type",
        "1.0 AS value", "'{}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    tasks = _askable(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 150
