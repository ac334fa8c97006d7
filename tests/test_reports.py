"""Feeds and statistics on small tables, where the SQL checks do not reach."""

import json

from pyspark.sql import functions as F

from hexwarden.operators import alerts as alert_ops, events, rules
from hexwarden.plans import feeds, requests, stats


def _alerts(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, transaction_id bigint, risk_score int, risk_summary string, telegram_sent boolean, at string")
    return df.withColumn("created_at", F.to_timestamp("at")).drop("at")


def _base(spark):
    alerts = _alerts(
        spark,
        [
            (1, 10, 90, "", True, "2024-01-01"), (2, 11, 75, None, False, "2024-01-03"), (3, 11, 71, "s<1>", False, "2024-01-03"),
            (4, 12, 99, "x", True, "2024-01-02"),
        ],
    )
    transactions = spark.createDataFrame([(10, "h10", 1), (11, "h11", 2), (12, "h12", 1)], "id bigint, tx_hash string, protocol_id bigint")
    protocols = spark.createDataFrame([(1, "one"), (2, "two & <co>")], "id bigint, name string")
    return alerts, transactions, protocols


def test_alert_feed_order_and_clamp(spark):
    alerts, transactions, protocols = _base(spark)
    for enforced in (True, False):
        rows = feeds.recent_alerts(alerts, transactions, protocols, keys_enforced=enforced).collect()
        assert [r.id for r in rows] == [3, 2, 4, 1] and rows[0].protocol_name == "two & <co>"
    assert [r.id for r in feeds.recent_alerts(alerts, transactions, protocols, 0).collect()] == [3]
    orphan = alerts.union(_alerts(spark, [(5, 77, 80, "", False, "2025-01-01")]))
    kept = feeds.recent_alerts(orphan, transactions, protocols, 1).collect()
    assert [r.id for r in kept] == [3]


def test_strip_texts_and_range(spark):
    alerts, transactions, protocols = _base(spark)
    texts = {r.id: r.text for r in feeds.alert_strip(alerts, transactions, protocols).collect()}
    assert texts[1] == texts[2] == "High risk transaction detected" and texts[4] == "x"
    assert [r.id for r in feeds.alert_range(alerts, transactions, protocols, 71, 90).collect()] == [3, 2, 1]


def test_range_does_not_reach_past_the_newest(spark):
    rows = [(n, 10, 80, "", True, f"2024-01-01 00:{n // 60:02}:{n % 60:02}") for n in range(250)]
    rows[0] = (0, 10, 95, "", True, "2023-01-01")
    _, transactions, protocols = _base(spark)
    assert feeds.alert_range(_alerts(spark, rows), transactions, protocols, 95, 95).count() == 0
    assert feeds.alert_range(_alerts(spark, rows), transactions, protocols).count() == 200


def test_limits_are_clamped():
    assert [feeds.clamp(n, 200) for n in (-3, 0, 1, 200, 201)] == [1, 1, 1, 200, 200]


def test_outbox_escapes_and_tolerates_missing_protocol(spark):
    alerts, transactions, _ = _base(spark)
    protocols = spark.createDataFrame([(2, "two & <co>")], "id bigint, name string")
    got = {r.alert_id: r.message for r in alert_ops.outbox(alerts, transactions, protocols).collect()}
    assert set(got) == {2, 3} and "two &amp; &lt;co&gt;" in got[2] and "<code>75</code>" in got[2]
    lost = alert_ops.outbox(alerts, transactions.withColumn("protocol_id", F.lit(9)), protocols).collect()
    assert all("Unknown" in r.message for r in lost)


def test_new_alerts_and_delivery(spark):
    scored = spark.createDataFrame([(1, 69, "a"), (2, 70, "b"), (3, None, "c"), (4, 100, None)], "id bigint, risk_score int, risk_summary string")
    rows = alert_ops.new_alerts(scored, F.lit(100), as_of="2024-01-01 00:00:00").collect()
    assert sorted((r.transaction_id, r.risk_score) for r in rows) == [(2, 70), (4, 100)]
    assert sorted(r.id for r in rows) == [101, 102] and not any(r.telegram_sent for r in rows)
    assert alert_ops.new_alerts(scored, F.lit(0), threshold=101).count() == 0
    receipts = spark.createDataFrame([(2,), (2,), (77,)], "alert_id bigint")
    sent = {r.id: r.telegram_sent for r in alert_ops.mark_delivered(_base(spark)[0], receipts).collect()}
    assert sent == {1: True, 2: True, 3: False, 4: True}


def test_delivery_events(spark):
    alerts = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "id bigint, telegram_sent boolean")
    receipts = spark.createDataFrame([(2,), (2,), (3,), (77,), (None,)], "alert_id bigint")
    lines = events.delivery_events(alerts, receipts, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()
    got = sorted((e["alert_id"], e["level"], e["event"]) for e in (json.loads(r.line) for r in lines))
    failed = ("WARNING", "alert.telegram.failed")
    assert got == [(1, *failed), (2, "INFO", "alert.telegram.sent"), (4, *failed)]


def test_shown_protocol(spark):
    def table(rows):
        df = spark.createDataFrame(rows, "id bigint, is_active boolean, at string")
        return df.selectExpr("id", "'n' AS name", "'a' AS address", "'c' AS chain", "is_active", "0L AS last_seen_block", "timestamp(at) AS created_at")

    rows = [(1, True, "2024-01-01"), (2, True, "2024-01-02"), (3, False, "2024-01-03")]
    assert feeds.shown_protocol(table(rows)).first().id == 2
    assert feeds.shown_protocol(table([(i, False, at) for i, _, at in rows])).first().id == 3
    assert [r.id for r in feeds.protocol_list(table(rows)).collect()] == [3, 2, 1]
    assert [r.id for r in feeds.protocol_list(table(rows), active_only=True).collect()] == [2, 1]


def test_lookups_use_stored_lower_case(spark):
    df = spark.createDataFrame([(1, "0xAB", "0xab"), (2, "0xCD", "0xcd")], "id int, address string, address_lc string")
    assert [r.id for r in feeds.protocol_by_address(df, "0xaB").collect()] == [1]
    assert [r.id for r in feeds.protocol_by_address(df.drop("address_lc"), "0xaB").collect()] == [1]


def test_alert_stats_count_future_rows_in_the_week(spark):
    days = ["2024-01-10 00:00:00", "2024-01-10 23:59:59", "2024-01-11 00:00:00", "2024-01-03 12:00:00", "2024-01-03 11:59:59", "2030-01-01"]
    alerts = _alerts(spark, [(n, 10, 80, "", True, d) for n, d in enumerate(days)])
    assert tuple(stats.alert_stats(alerts, "2024-01-10 12:00:00").first()) == (2, 5, 6)
    assert tuple(stats.alert_stats(alerts.limit(0), "2024-01-10 12:00:00").first()) == (0, 0, 0)


def test_daily_requests_fill_empty_days(spark):
    log = spark.createDataFrame([("2024-01-10 01:00:00",), ("2024-01-10 02:00:00",), ("2024-01-04 00:00:00",), ("2024-01-03 23:59:59",), ("2024-01-11 00:00:00",)], "at string")
    log = log.withColumn("created_at", F.to_timestamp("at"))
    rows = stats.daily_requests(spark, log, "2024-01-10 12:00:00").collect()
    assert [(r.date, r.requests) for r in rows] == [
        ("2024-01-04", 1), ("2024-01-05", 0), ("2024-01-06", 0), ("2024-01-07", 0), ("2024-01-08", 0), ("2024-01-09", 0), ("2024-01-10", 2),
    ]


def test_counts_on_empty_tables(spark):
    scores = spark.createDataFrame([], "risk_score int")
    assert tuple(stats.risk_histogram(scores).first()) == (0, 0, 0, 0)
    flags = spark.createDataFrame([], "is_active boolean")
    assert tuple(stats.public_stats(flags, scores, scores).first()) == (0, 0, 0, 1)


def test_histogram_leaves_out_what_the_bands_label(spark):
    scores = spark.createDataFrame([(s,) for s in (None, -1, 0, 30, 31, 70, 71, 100, 101)], "risk_score int")
    assert tuple(stats.risk_histogram(scores).first()) == (2, 1, 1, 2)
    assert {r.band: r.transactions for r in stats.risk_bands(scores).collect()} == {"PENDING": 1, "LOW": 3, "MEDIUM": 1, "ELEVATED": 1, "HIGH": 3}


def test_only_api_paths_are_logged(spark):
    df = spark.createDataFrame([("/api/alerts", "GET"), ("/api/index.py/alerts", "GET"), ("/", "GET"), ("/assets/api", "GET")], "endpoint string, method string")
    assert requests.loggable(df).count() == 2
    assert {r.route: r.requests for r in requests.requests_per_route(requests.loggable(df)).collect()} == {"/api/alerts": 2}


def test_rule_scores(spark):
    df = spark.createDataFrame(
        [
            ("plain", "s1", 0.5, 21000, "0x", "2024-01-01 12:00:00"), ("busy", "s2", 0.5, 400000, "0xdeadbeef00", "2024-01-01 12:00:00"),
            ("big", "s2", 5000.0, 21000, "0x", "2024-01-01 03:00:00"), ("bad", "S9", 5000.0, 400000, "0xdeadbeef" + "0" * 300, "2024-01-01 03:00:00"),
            ("null", None, None, None, None, "2024-01-01 12:00:00"),
        ],
        "tx_hash string, from_address string, value_eth double, gas_used bigint, input_data string, at string",
    ).withColumn("fetched_at", F.to_timestamp("at"))
    flagged = spark.createDataFrame([("s9",), ("S9",)], "address string")
    got = {r.tx_hash: r for r in rules.rule_scores(df, flagged, rules.RuleWeights(selectors=("0xdeadbeef",))).collect()}
    assert {h: r.risk_score for h, r in got.items()} == {"plain": 30, "busy": 70, "big": 60, "bad": 100, "null": 20}
    assert got["bad"].risk_factors == ["flagged sender", "known selector", "large value"] and len(got) == 5
    assert got["null"].risk_summary == "No factor applies"
