"""A third of all rows behind one key: results stay whole."""

import pytest

import __spark_entry__ as entry
from skewed import skewed_copy
from twins import connect, rows_of_query, rows_of_sql

SHUFFLED = [
    "strict_events", "order_items", "quality_flags", "latest_orders", "latest_order_items", "product_demand_daily",
    "store_daily_summary", "pressure_window", "latency_stats", "replay_batches", "publish_by_hour", "dedup_events",
]


@pytest.fixture(scope="module")
def hot_dir(sf_dir, tmp_path_factory):
    return skewed_copy(sf_dir, str(tmp_path_factory.mktemp("hot")))


@pytest.fixture
def no_broadcast(spark):
    """Every join shuffles, and AQE splits partitions from a few kilobytes on."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        # A partition is split by the tasks that wrote it, so the scan needs several.
        "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.files.openCostInBytes": "0",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", SHUFFLED)
def test_hot_keys_through_shuffles(spark, hot_dir, no_broadcast, name):
    df = entry.queries()[name](spark, hot_dir)
    assert rows_of_query(df) == rows_of_sql(connect(hot_dir), entry.oracle_sql()[name])


def test_hot_order_is_split_by_the_join(spark, hot_dir, no_broadcast):
    df = entry.queries()["order_items"](spark, hot_dir)
    df.collect()
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
