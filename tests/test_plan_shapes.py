"""Physical plans: what must and must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

from checks import catalog, views
from hexwarden.operators import ingest, matching
from hexwarden.plans import stats
from hexwarden.session import shuffle_settings

SF = "/root/testdata/sf0.001"
LAZY = [name for name in catalog.QUERIES if not re.match("stream_|rate_limit|append_|log_events|landed_|insert_", name)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_product_joins_and_no_row_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", text)


def test_match_is_an_equi_join_without_broadcast_too(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalog.QUERIES["match_transactions"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "NestedLoop" not in text and "BroadcastExchange" not in text


def test_copies_of_a_hash_shrink_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["first_writer"](spark, SF))
    assert "Partial" in text and text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_feeds_do_not_sort_the_table(spark):
    for name in ("recent_transactions", "recent_alerts", "top_keys", "shown_protocol"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_alert_feed_does_not_shuffle_the_big_tables(spark):
    assert "Exchange hashpartitioning" not in plan(catalog.QUERIES["recent_alerts"](spark, SF))


def test_day_filters_reach_the_scan(spark, tmp_path):
    log = views.request_log(spark, SF).withColumn("api_key_id", F.col("api_key_id"))
    log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    for df in (stats.requests_on_day(log, "2024-01-30 12:00:00"), stats.daily_requests(spark, log, "2024-01-30 12:00:00")):
        text = plan(df)
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(created_at", text), text
        assert "ReadSchema: struct<created_at:timestamp>" in text


def test_overview_reads_each_table_once(spark):
    text = plan(catalog.QUERIES["admin_overview"](spark, SF))
    assert text.count("FileScan") == 6 and "CartesianProduct" not in text


def test_small_batches_do_not_shuffle_the_table(spark, tmp_path):
    spark.range(1000).select(F.concat(F.lit("h"), "id").alias("tx_hash")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("h1",), ("x",)], "tx_hash string").write.parquet(str(tmp_path / "b"))
    text = plan(ingest.absent_from(spark.read.parquet(str(tmp_path / "b")), table, "tx_hash"))
    assert text.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(catalog.QUERIES["risk_histogram"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


def test_busy_address_is_split_when_the_registry_is_not_broadcast(spark):
    """One address in half of all rows: adaptive execution cuts its partition, and no row is lost."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        raw = spark.range(0, 100_000, numPartitions=8).select(
            F.concat(F.lit("h"), F.sha2(F.col("id").cast("string"), 256)).alias("hash"),
            F.when(F.col("id") % 2 == 0, "0xhot").otherwise(F.concat(F.lit("0x"), F.col("id") % 900)).alias("to"),
            F.lit(None).cast("string").alias("from"),
            F.lit("").alias("input"),
        )
        watched = spark.range(900).select("id", F.concat(F.lit("0x"), "id").alias("address"))
        watched = watched.union(spark.sql("SELECT 1000L, '0xHOT'")).withColumn("created_at", F.current_timestamp())
        df = matching.match(raw, watched)
        assert df.count() == 100_000
        df.write.format("noop").mode("overwrite").save()
        counted = df.select("hash", "protocol_id")
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small:
            spark.conf.unset(key)


def test_shuffle_settings_grow_with_the_data():
    count = "spark.sql.shuffle.partitions"
    assert shuffle_settings(10**6, 8)[count] == "16"
    assert int(shuffle_settings(100 * 10**12, 8000)[count]) > 700_000
