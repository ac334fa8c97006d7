"""The queries: every operator on the whole of the driver's tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import views as v
from checks.oracles import ALERTS_AS_OF, FEED_AS_OF, LOG_AS_OF
from hexwarden import schemas
from hexwarden.functions.answers import parse_answers
from hexwarden.operators import (
    alerts as alert_ops,
    events,
    ingest,
    keys,
    limiter,
    load,
    matching,
    polling,
    registry,
    rules,
    scoring,
    waitlist as waitlist_ops,
)
from hexwarden.operators.ids import highest_id
from hexwarden.plans import feeds, requests, stats
from hexwarden.session import SETTINGS
from hexwarden.sources import chain, eventlog, tables
from hexwarden.streaming import ingest as stream_ingest, limits as stream_limits
from hexwarden.workspace import run_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Blocks of a landed group and of a landed file; the streams take five files per micro-batch.
LANDED_BLOCKS = 1_250
PROTOCOL_COLUMNS = ("id", "name", "address", "chain", "is_active", "last_seen_block", "created_at")
DECODED_COLUMNS = (
    "tx_hash", "block_number", "from_address", "to_address", "value_eth", "gas_used", "input_data",
)
AUDIT_LIMITS = limiter.Limits(per_minute=1, per_day=5, minute_seconds=3600)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# Feeds, lists, lookups


@query
def recent_alerts(spark, sf):
    return feeds.recent_alerts(v.alerts(spark, sf), v.transactions(spark, sf), v.protocols(spark, sf))


@query
def alert_strip(spark, sf):
    return feeds.alert_strip(v.alerts(spark, sf), v.transactions(spark, sf), v.protocols(spark, sf))


@query
def alert_range(spark, sf):
    return feeds.alert_range(v.alerts(spark, sf), v.transactions(spark, sf), v.protocols(spark, sf), 80, 90)


@query
def recent_transactions(spark, sf):
    return feeds.recent_transactions(v.transactions(spark, sf))


@query
def protocol_transactions(spark, sf):
    return feeds.recent_transactions(v.transactions(spark, sf), protocol_id=3, limit=1000)


@query
def transaction_rows(spark, sf):
    return feeds.transaction_rows(feeds.recent_transactions(v.transactions(spark, sf)), FEED_AS_OF)


@query
def shown_transaction_count(spark, sf):
    return feeds.shown_transaction_count(v.transactions(spark, sf), protocol_id=3)


@query
def demo_feed(spark, sf):
    return feeds.demo_feed(v.transactions(spark, sf))


@query
def protocol_list(spark, sf):
    return feeds.protocol_list(v.protocols(spark, sf))


@query
def active_protocols(spark, sf):
    return feeds.protocol_list(v.protocols(spark, sf), active_only=True)


@query
def shown_protocol(spark, sf):
    return feeds.shown_protocol(v.protocols(spark, sf))


@query
def protocol_by_id(spark, sf):
    return feeds.protocol_by_id(v.protocols(spark, sf), 7)


@query
def protocol_lookup(spark, sf):
    return feeds.protocol_by_address(v.protocols(spark, sf), "0x" + "B0".rjust(40, "0"))


@query
def tx_lookup(spark, sf):
    # SHA-256 of "42".
    wanted = "0x73475cb40a568e8da8a045ced110137e159f890ac4da883b6b17dc651b3a8049"
    return feeds.transaction_by_hash(v.transactions(spark, sf), wanted).select(*feeds.TRANSACTION_VIEW)


@query
def key_lookup(spark, sf):
    # SHA-256 of "key-7".
    wanted = "78ed7d2bf2a8c4af4a3d3652a89fe8b9f46addb8bc8e7cb69106a6467900f5e6"
    return feeds.active_key_by_hash(v.api_keys(spark, sf), wanted).select(*feeds.KEY_VIEW)


@query
def waitlist_lookup(spark, sf):
    applications = v.waitlist(spark, sf)
    wanted = applications.filter("id = 7").select(F.upper("email")).scalar()
    return feeds.waitlist_by_email(applications, wanted).select("id", "email", "status")


@query
def key_list(spark, sf):
    return feeds.key_list(v.api_keys(spark, sf))


@query
def top_keys(spark, sf):
    return feeds.top_keys(v.api_keys(spark, sf))


@query
def waitlist_list(spark, sf):
    return feeds.waitlist_list(v.waitlist(spark, sf))


# Statistics


@query
def alert_stats(spark, sf):
    return stats.alert_stats(v.alerts(spark, sf), ALERTS_AS_OF)


@query
def public_stats(spark, sf):
    return stats.public_stats(v.protocols(spark, sf), v.transactions(spark, sf), v.alerts(spark, sf))


@query
def admin_overview(spark, sf):
    return stats.admin_overview(
        v.api_keys(spark, sf),
        v.waitlist(spark, sf),
        v.protocols(spark, sf),
        v.transactions(spark, sf),
        v.alerts(spark, sf),
        v.request_log(spark, sf),
        LOG_AS_OF,
    )


@query
def requests_today(spark, sf):
    return stats.requests_on_day(v.request_log(spark, sf), LOG_AS_OF)


@query
def risk_histogram(spark, sf):
    return stats.risk_histogram(v.transactions(spark, sf))


@query
def risk_bands(spark, sf):
    return stats.risk_bands(v.transactions(spark, sf))


@query
def daily_requests(spark, sf):
    return stats.daily_requests(spark, v.request_log(spark, sf), LOG_AS_OF)


@query
def waitlist_counts(spark, sf):
    return stats.waitlist_counts(v.waitlist(spark, sf))


@query
def waitlist_domains(spark, sf):
    return stats.waitlist_domains(v.waitlist(spark, sf))


# Request log and keys


@query
def key_usage(spark, sf):
    counted = keys.count_usage(v.api_keys(spark, sf), v.request_log(spark, sf))
    return counted.select("id", "requests_today", "requests_total", "last_used_at")


@query
def key_usage_of_day(spark, sf):
    counted = keys.count_usage(v.api_keys(spark, sf), v.request_log(spark, sf), LOG_AS_OF, daily=True)
    return counted.select("id", "requests_today", "requests_total")


@query
def key_usage_daily(spark, sf):
    return keys.usage_per_key_and_day(v.request_log(spark, sf))


@query
def validate_keys(spark, sf):
    return keys.check_keys(v.presented_keys(spark, sf), v.api_keys(spark, sf)).drop("api_key")


@query
def authenticate_keys(spark, sf):
    checked = keys.check_keys(v.presented_keys(spark, sf), v.api_keys(spark, sf), strip_text=False)
    return checked.drop("api_key")


@query
def revoke_keys(spark, sf):
    return keys.revoke_keys(v.api_keys(spark, sf), v.revocations(spark, sf)).select("id", "is_active")


@query
def revocation_outcomes(spark, sf):
    return keys.revocation_outcomes(v.api_keys(spark, sf), v.revocations(spark, sf))


@query
def add_keys(spark, sf):
    added = keys.add_keys(v.new_keys(spark, sf), v.api_keys(spark, sf), LOG_AS_OF)
    return added.select("id", "key_hash", "key_prefix", "name", "is_active", "requests_total")


@query
def offered_load(spark, sf):
    calls = v.request_log(spark, sf).select("id", "api_key_id", "created_at")
    return load.offered_load(calls, {"last_minute": 60, "last_day": 86_400}).drop("created_at")


@query
def rate_limit_audit(spark, sf):
    return limiter.audit(v.request_log(spark, sf), AUDIT_LIMITS)


@query
def rate_limit_defaults(spark, sf):
    return limiter.audit(v.request_log(spark, sf))


@query
def append_requests(spark, sf):
    root = run_dir(spark, "requests")
    tables.write_batch(requests.loggable(v.raw_requests(spark, sf)), root, "request_log", 0)
    return tables.read_table(spark, root, "request_log").groupBy("day").agg(F.count(F.lit(1)).alias("requests"))


@query
def clean_routes(spark, sf):
    return requests.requests_per_route(v.raw_requests(spark, sf))


def _event_lines(spark, sf):
    log = v.request_log(spark, sf)
    line = eventlog.event_line(
        F.col("created_at"),
        F.when(F.col("status_code") == 429, "WARNING").otherwise("INFO"),
        F.lit("api.request"),
        {"id": F.col("id"), "endpoint": F.col("endpoint"), "duration_ms": F.col("response_ms")},
    )
    return log.select("id", line.alias("line"))


@query
def log_lines(spark, sf):
    return _event_lines(spark, sf)


@query
def log_events(spark, sf):
    path = run_dir(spark, "events")
    eventlog.write_events(_event_lines(spark, sf), path)
    return eventlog.read_events(spark, path).select(
        eventlog.event_field("id", "bigint").alias("id"),
        "ts",
        "level",
        "service",
        "event",
        eventlog.event_field("endpoint").alias("endpoint"),
        eventlog.event_field("duration_ms", "int").alias("duration_ms"),
    )


# Chain data


def _decoded_view(decoded):
    return decoded.select(*DECODED_COLUMNS, F.col("value_wei").cast("string").alias("value_wei"))


def _raw(spark, sf):
    return v.raw_transactions(spark, sf).drop("pos", "gasUsed")


def _decoded(spark, sf):
    return matching.decode(matching.with_receipts(_raw(spark, sf), v.receipts(spark, sf)))


def _matched_raw(spark, sf):
    return matching.with_block_number(matching.match(_raw(spark, sf), v.protocols(spark, sf)))


def _matched(spark, sf):
    return matching.decode(matching.with_receipts(_matched_raw(spark, sf), v.receipts(spark, sf)))


def _land_blocks(spark, sf):
    """Land all blocks, cut by groups of them."""
    landing = chain.Landing(run_dir(spark, "landed"), LANDED_BLOCKS, LANDED_BLOCKS)
    landing.land_blocks(v.blocks(spark, sf))
    return landing


def _land(spark, sf):
    """Land all blocks and receipts."""
    landing = _land_blocks(spark, sf)
    landing.land_receipts(v.receipts(spark, sf))
    return landing


def _head(spark, sf):
    return chain.head_block(v.raw_transactions(spark, sf).select(F.col("blockNumber").alias("number")))


@query
def landed_transactions(spark, sf):
    landing = _land(spark, sf)
    raw = chain.block_transactions(landing.blocks(spark))
    return _decoded_view(matching.decode(matching.with_receipts(raw, landing.receipts(spark))))


@query
def head_block(spark, sf):
    return chain.head_block(v.blocks(spark, sf))


@query
def landed_head(spark, sf):
    return _land_blocks(spark, sf).head(spark)


@query
def decode_transactions(spark, sf):
    return _decoded_view(_decoded(spark, sf))


@query
def match_transactions(spark, sf):
    return _matched(spark, sf).select("tx_hash", "protocol_id", "block_number", "value_eth", "gas_used")


@query
def first_writer(spark, sf):
    return ingest.first_writer(_matched(spark, sf)).select("tx_hash", "protocol_id", "block_number")


@query
def insert_transactions(spark, sf):
    rows = ingest.insert_transactions(_matched(spark, sf), v.stored_transactions(spark, sf), LOG_AS_OF)
    return rows.select("id", "protocol_id", *DECODED_COLUMNS)


@query
def insert_outcomes(spark, sf):
    return ingest.insert_outcomes(_matched(spark, sf), v.stored_transactions(spark, sf))


@query
def poll_windows(spark, sf):
    windows = polling.poll_windows(v.protocols(spark, sf), _head(spark, sf))
    return windows.select("protocol_id", "address", "from_block", "to_block")


def _matched_of(spark, sf, landing, ranges):
    """Matches in the landed blocks of the groups that ``ranges`` touch."""
    raw = chain.block_transactions(landing.blocks_of(spark, ranges))
    return matching.with_block_number(matching.match(raw, v.protocols(spark, sf)))


@query
def window_transactions(spark, sf):
    landing = _land_blocks(spark, sf)
    windows = written(polling.poll_windows(v.protocols(spark, sf), landing.head(spark)), "windows")
    rows = polling.in_windows(_matched_of(spark, sf, landing, windows), windows)
    return matching.decode(rows).select("tx_hash", "protocol_id", "block_number")


@query
def advance_cursor(spark, sf):
    windows = polling.poll_windows(v.protocols(spark, sf), _head(spark, sf))
    return polling.advance_cursor(v.protocols(spark, sf), windows).select("id", "last_seen_block")


@query
def backfill_new_protocol(spark, sf):
    new = v.protocols(spark, sf).withColumn("last_seen_block", F.lit(None).cast("bigint"))
    rows = polling.backfill(_matched_raw(spark, sf), new, _head(spark, sf))
    rows = matching.decode(matching.with_receipts(rows, v.receipts(spark, sf)))
    return rows.select("tx_hash", "protocol_id", "block_number", "gas_used")


@query
def landed_backfill(spark, sf):
    landing = _land(spark, sf)
    new = v.protocols(spark, sf).withColumn("last_seen_block", F.lit(None).cast("bigint"))
    head = written(landing.head(spark), "head")
    ranges = written(polling.catch_up_range(new, head), "ranges")
    rows = polling.backfill(_matched_of(spark, sf, landing, ranges), new, head)
    rows = matching.decode(matching.with_receipts(rows, landing.receipts_of(spark, ranges)))
    return rows.select("tx_hash", "protocol_id", "block_number", "gas_used")


# Scores and alerts


def _factors_as_text(scores):
    # One text: an empty list for usable answers without factors.
    return scores.withColumn("risk_factors", F.array_join("risk_factors", ", "))


def _resolved(spark, sf):
    return scoring.resolve_scores(v.transactions(spark, sf), v.score_answers(spark, sf).select("tx_hash", "content"))


def _answered(spark, sf):
    """Scores of the transactions that got an answer."""
    parsed = scoring.with_fallback(parse_answers(v.score_answers(spark, sf)))
    return parsed.select("tx_hash", "risk_score", "risk_summary", "risk_factors")


@query
def parse_scores(spark, sf):
    parsed = scoring.with_fallback(parse_answers(v.score_answers(spark, sf)))
    return _factors_as_text(parsed.select("id", "tx_hash", "risk_score", "risk_summary", "risk_factors"))


@query
def resolve_scores(spark, sf):
    return _factors_as_text(_resolved(spark, sf))


@query
def apply_scores(spark, sf):
    scored = scoring.apply_scores(v.transactions(spark, sf), _answered(spark, sf), ALERTS_AS_OF)
    return scored.select("id", "risk_score", "risk_summary", "scored_at")


@query
def rescore(spark, sf):
    asked = v.load(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("id"))
    all_transactions = v.transactions(spark, sf)
    hashes = all_transactions.join(asked, "id", "left_semi").select("tx_hash")
    answers = v.score_answers(spark, sf).select("tx_hash", "content")
    scored = scoring.rescore(
        all_transactions,
        hashes,
        lambda wanted: answers.join(wanted.select("tx_hash"), "tx_hash", "left_semi"),
        v.protocols(spark, sf),
        ALERTS_AS_OF,
    )
    return scored.select("id", "risk_score", "scored_at")


@query
def unscored_requests(spark, sf):
    return scoring.scoring_requests(v.transactions(spark, sf), v.protocols(spark, sf))


@query
def rule_scores(spark, sf):
    weights = rules.RuleWeights(
        value_steps=((100.0, 15), (300.0, 20)),
        long_input_chars=60,
        # First four bytes of SHA-256 of "1-URGENT".
        selectors=("0x29af6fda",),
        rare_sender_upto=5,
    )
    scored = rules.rule_scores(v.transactions(spark, sf), v.flagged_addresses(spark, sf), weights)
    return scored.select("tx_hash", "risk_score")


@query
def new_alerts(spark, sf):
    unscored = v.transactions(spark, sf).filter("risk_score IS NULL").select("id", "tx_hash")
    scored = unscored.join(_answered(spark, sf), "tx_hash").select("id", "risk_score", "risk_summary")
    scored = written(scored, "scored")
    return alert_ops.new_alerts(scored, highest_id(v.alerts(spark, sf)), as_of=ALERTS_AS_OF)


@query
def alert_outbox(spark, sf):
    return alert_ops.outbox(v.alerts(spark, sf), v.transactions(spark, sf), v.protocols(spark, sf))


@query
def mark_delivered(spark, sf):
    return alert_ops.mark_delivered(v.alerts(spark, sf), v.deliveries(spark, sf)).select("id", "telegram_sent")


@query
def monitor_events(spark, sf):
    scored = v.transactions(spark, sf).withColumn("scored_at", F.when(F.col("risk_score") >= 50, F.col("fetched_at")))
    return events.monitor_events(scored, v.alerts(spark, sf), v.protocols(spark, sf))


@query
def delivery_events(spark, sf):
    return events.delivery_events(v.alerts(spark, sf), v.deliveries(spark, sf), F.col("created_at"))


# Registries


@query
def protocol_registration(spark, sf):
    rows = registry.registration_outcomes(v.registration_requests(spark, sf), v.protocols(spark, sf))
    return rows.select("request_id", "address", "outcome")


@query
def register_protocols(spark, sf):
    rows = registry.register_protocols(v.registration_requests(spark, sf), v.protocols(spark, sf), LOG_AS_OF)
    return rows.select("id", "name", "address", "chain", "is_active")


@query
def protocol_toggle(spark, sf):
    return registry.toggle_protocols(v.protocols(spark, sf), v.toggles(spark, sf)).select("id", "is_active")


def _deleted(spark, sf):
    return registry.delete_protocols(
        v.protocols(spark, sf), v.transactions(spark, sf), v.alerts(spark, sf), v.deletions(spark, sf)
    )


@query
def delete_protocols(spark, sf):
    return _deleted(spark, sf)[0]


@query
def delete_protocols_transactions(spark, sf):
    return _deleted(spark, sf)[1].select("id", "protocol_id", "tx_hash")


@query
def delete_protocols_alerts(spark, sf):
    return _deleted(spark, sf)[2].select("id", "transaction_id", "risk_score")


@query
def waitlist_applications(spark, sf):
    rows = waitlist_ops.application_outcomes(v.applications(spark, sf), v.waitlist(spark, sf))
    return rows.select("request_id", "email", "outcome")


@query
def add_applications(spark, sf):
    rows = waitlist_ops.add_applications(v.applications(spark, sf), v.waitlist(spark, sf), LOG_AS_OF)
    return rows.select("id", "email", "name", "project", "status")


@query
def decision_outcomes(spark, sf):
    rows = waitlist_ops.decision_outcomes(v.waitlist(spark, sf), v.decisions(spark, sf))
    return rows.select("decision_id", "outcome")


@query
def waitlist_decisions(spark, sf):
    rows = waitlist_ops.decide(v.waitlist(spark, sf), v.decisions(spark, sf))
    return rows.select("id", "status", "api_key_id", "reviewed_at")


# Streams: landed files in, tables out


def run_monitor(spark, sf) -> str:
    """Run the monitoring loop over all landed blocks; returns the folder of its tables."""
    landing, root = _land(spark, sf), run_dir(spark, "monitor")
    # Every batch asks for answers of its own hashes: they are made once, and a batch's hashes are sent to them.
    answers = written(v.score_answers(spark, sf).select("tx_hash", "content"), "score-answers")
    job = stream_ingest.MonitorJob(
        root=root,
        registry=lambda session: v.protocols(session, sf),
        receipts=lambda first, last: landing.receipts_between(spark, first, last),
        provider=lambda wanted: answers.join(F.broadcast(wanted.select("tx_hash")), "tx_hash", "left_semi"),
        as_of=LOG_AS_OF,
    )
    stream = landing.stream(spark)
    stream_ingest.start_monitor(stream, job, f"{root}/_checkpoint", once=True).awaitTermination()
    return root


@query
def stream_ingest_tables(spark, sf):
    return tables.read_table(spark, run_monitor(spark, sf), "transactions").select(
        "tx_hash", "protocol_id", "block_number", "value_eth", "gas_used", "risk_score", "risk_summary"
    )


@query
def stream_alerts(spark, sf):
    root = run_monitor(spark, sf)
    alerts = tables.read_table(spark, root, "alerts").select(F.col("id").alias("alert_id"), "risk_score")
    return stream_ingest.read_outbox(spark, root).join(alerts, "alert_id").select("tx_hash", "risk_score", "message")


@query
def stream_runs(spark, sf):
    runs = stream_ingest.read_runs(spark, run_monitor(spark, sf))
    return runs.agg(
        *[F.sum(c).alias(c) for c in ("blocks", "transactions_found", "alerts_fired")],
        F.max("protocols_checked").alias("protocols_checked"),
    )


@query
def stream_cursor(spark, sf):
    cursors = stream_ingest.read_cursors(spark, run_monitor(spark, sf))
    return polling.with_cursors(v.protocols(spark, sf), cursors).select("id", "last_seen_block")


@query
def stream_events(spark, sf):
    lines = stream_ingest.read_event_lines(spark, run_monitor(spark, sf))
    about = eventlog.parse_events(lines, "line").filter(F.col("event") != events.POLLED)
    return about.groupBy("event").agg(F.count(F.lit(1)).alias("lines"))


@query
def stream_rate_limit(spark, sf):
    """The calls land in three parts, in order of time; each is taken up by a new run of the same stream."""
    spark.conf.set(stream_limits.STATE_STORE, SETTINGS[stream_limits.STATE_STORE])
    root, calls = run_dir(spark, "calls"), v.request_log(spark, sf)
    low, high = (F.unix_micros(F.col(c)) for c in ("low", "high"))
    ends = calls.agg(F.min("created_at").alias("low"), F.max("created_at").alias("high")).select(low, high).first()
    third = (ends[1] - ends[0]) // 3 + 1
    parts = F.floor((F.unix_micros("created_at") - F.lit(ends[0])) / F.lit(third))
    for part in range(3):
        calls.filter(parts == part).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(schemas.REQUEST_LOG).parquet(f"{root}/landed")
        decided = stream_limits.limit_stream(stream, AUDIT_LIMITS)
        sink = decided.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
        sink.option("path", f"{root}/decisions").trigger(availableNow=True).start().awaitTermination()
    # The calls come in order of time, so none is late.
    return spark.read.schema(decided.schema).parquet(f"{root}/decisions").filter(~F.col("late")).drop("late")


# The name of the job's module is in use above.
QUERIES["stream_ingest"] = QUERIES.pop("stream_ingest_tables")
