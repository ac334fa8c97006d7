"""The SQL counterparts, for DuckDB over the driver's tables.

They say what is to come out in the plainest way (OR joins, ordered windows, list folds), not how the jobs
compute it.
"""

ALERTS_AS_OF = "1998-06-15 12:00:00"
LOG_AS_OF = "2024-01-30 12:00:00"
FEED_AS_OF = "2001-08-01 09:30:00"

VIEWS = {
    "protocols": """
        SELECT s_suppkey AS id, s_name AS name,
               '0x' || lpad(lower(hex(s_suppkey + 171)), 40, '0') AS address, 'ethereum' AS chain,
               s_suppkey % 4 <> 0 AS is_active, s_suppkey * 100 AS last_seen_block,
               CAST(DATE '2024-01-01' - CAST(s_suppkey AS INTEGER) AS TIMESTAMP) AS created_at
        FROM supplier""",
    "transactions": """
        SELECT o_orderkey AS id, o_custkey % 10 AS protocol_id,
               '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS tx_hash, o_orderkey AS block_number,
               '0x' || lpad(lower(hex(o_custkey + 100)), 40, '0') AS from_address,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL
                    ELSE '0x' || lpad(lower(hex(o_custkey % 10 + 171)), 40, '0') END AS to_address,
               o_totalprice / 1000 AS value_eth, 21000 + (o_orderkey % 50) * 10000 AS gas_used,
               '0x' || sha256(o_orderpriority) AS input_data,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 101 AS INTEGER) END AS risk_score,
               o_orderpriority AS risk_summary, CAST(NULL AS TIMESTAMP) AS scored_at, o_orderdate AS fetched_at
        FROM orders""",
    "stored": """
        SELECT t.* FROM transactions t JOIN orders ON o_orderkey = t.id WHERE o_orderstatus = 'F'""",
    "alerts": """
        SELECT id, id AS transaction_id, risk_score, risk_summary, id % 3 <> 0 AS telegram_sent,
               fetched_at AS created_at
        FROM transactions WHERE risk_score >= 70""",
    "request_log": """
        SELECT event_id AS id, CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS api_key_id,
               '/api/' || event_type AS endpoint, 'GET' AS method,
               CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status_code,
               CAST(floor(value) AS INTEGER) AS response_ms, ts AS created_at
        FROM events""",
    "raw_requests": """
        SELECT l.* REPLACE (CASE e.event_type WHEN 'view' THEN '/api/index.py/view'
                WHEN 'click' THEN '/api/index/click' WHEN 'signup' THEN '/api/index'
                WHEN 'error' THEN '/assets/error' ELSE '/api/' || e.event_type END AS endpoint)
        FROM request_log l JOIN events e ON e.event_id = l.id""",
    "api_keys": """
        SELECT user_id AS id, sha256('key-' || user_id) AS key_hash,
               substring(sha256('key-' || user_id), 1, 9) AS key_prefix, 'user-' || user_id AS name,
               CAST(NULL AS BIGINT) AS waitlist_id, user_id % 5 <> 0 AS is_active,
               count(*) AS requests_today, count(*) AS requests_total, max(ts) AS last_used_at, min(ts) AS created_at
        FROM events GROUP BY user_id""",
    "waitlist": """
        SELECT c_custkey AS id, c_name || '@' || lower(c_mktsegment) || '.example' AS email,
               CAST(NULL AS VARCHAR) AS name, c_mktsegment AS project, CAST(NULL AS VARCHAR) AS twitter,
               CASE c_nationkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status,
               CAST(NULL AS BIGINT) AS api_key_id,
               CAST(DATE '2024-01-01' - CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS applied_at,
               CAST(NULL AS TIMESTAMP) AS reviewed_at
        FROM customer""",
    "score_answers": """
        SELECT event_id AS id, '0x' || sha256(CAST(event_id AS VARCHAR)) AS tx_hash,
               CASE event_id % 7 WHEN 0 THEN 'not json'
                    WHEN 1 THEN '```json' || chr(10) || replace(props, '"k"', '"risk_score"') || chr(10) || '```'
                    WHEN 2 THEN '{"risk_score": 150}' WHEN 3 THEN '{"risk_score": "87"}'
                    WHEN 4 THEN '{"risk_score": 87.5}' ELSE replace(props, '"k"', '"risk_score"') END AS content
        FROM events""",
    "raw_tx": """
        SELECT o_orderkey AS pos, o_orderkey // 10 AS block_number,
               '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS hash,
               '0x' || CASE WHEN o_orderkey % 2 = 0 THEN upper(lpad(hex(o_custkey + 100), 40, '0'))
                            ELSE lower(lpad(hex(o_custkey + 100), 40, '0')) END AS sender,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL
                    WHEN o_orderkey % 2 = 1 THEN '0x' || upper(lpad(hex(o_custkey % 20 + 171), 40, '0'))
                    ELSE '0x' || lower(lpad(hex(o_custkey % 20 + 171), 40, '0')) END AS target,
               CAST(round(o_totalprice * 100) AS HUGEINT) * 281474976710656 AS wei,
               CASE WHEN o_orderkey % 5 = 0 THEN 21000 + o_orderkey % 1000 ELSE 21000 END AS gas_used,
               substring('0x' || repeat(sha256(o_orderpriority), 10), 1, 500) AS input_data
        FROM orders""",
    "decoded": """
        SELECT pos, hash AS tx_hash, block_number, sender AS from_address, target AS to_address,
               CAST(wei AS VARCHAR) AS value_wei,
               CAST(CASE WHEN wei < 1000000000000000000 THEN '0.' || lpad(CAST(wei AS VARCHAR), 18, '0')
                    ELSE left(CAST(wei AS VARCHAR), -18) || '.' || right(CAST(wei AS VARCHAR), 18) END AS DOUBLE)
                    AS value_eth,
               gas_used, input_data
        FROM raw_tx""",
    "matched": """
        SELECT d.*, p.id AS protocol_id, p.created_at AS protocol_created_at, p.is_active
        FROM decoded d JOIN protocols p
          ON lower(coalesce(d.to_address, '')) = lower(p.address) OR lower(coalesce(d.from_address, '')) = lower(p.address)""",
    "first_writers": """
        SELECT * EXCLUDE (r) FROM (
            SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY protocol_created_at DESC, protocol_id) AS r
            FROM matched) WHERE r = 1""",
    "active_writers": """
        SELECT * EXCLUDE (r) FROM (
            SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY protocol_created_at DESC, protocol_id) AS r
            FROM matched WHERE is_active) WHERE r = 1""",
    "answer_text": """
        SELECT id, tx_hash, content,
               CASE WHEN content LIKE '```%' THEN trim(replace(replace(content, '```json', ''), '```', ''), ' ' || chr(10))
                    ELSE content END AS body
        FROM score_answers""",
    "parsed": """
        SELECT id, tx_hash, content,
               CASE WHEN json_valid(body)
                     AND json_type(CASE WHEN json_valid(body) THEN body END, '$.risk_score') IN ('UBIGINT', 'BIGINT')
                    THEN CASE WHEN CAST(json_extract(CASE WHEN json_valid(body) THEN body END, '$.risk_score') AS BIGINT)
                                   BETWEEN 0 AND 100
                              THEN CAST(json_extract(CASE WHEN json_valid(body) THEN body END, '$.risk_score') AS INTEGER)
                         END END AS good
        FROM answer_text""",
    "scores": """
        SELECT id, tx_hash, coalesce(good, 50) AS risk_score,
               CASE WHEN good IS NULL THEN 'Scoring unavailable' ELSE 'No summary available' END AS risk_summary,
               CASE WHEN good IS NULL THEN 'Scoring failed' ELSE '' END AS risk_factors
        FROM parsed""",
    "registrations": """
        SELECT c_custkey AS request_id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS name,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN '0x123'
                    WHEN c_custkey % 2 = 0 THEN '0x' || upper(lpad(hex(c_custkey - c_custkey % 3 + 171), 40, '0'))
                    ELSE '0x' || lower(lpad(hex(c_custkey - c_custkey % 3 + 171), 40, '0')) END AS address
        FROM customer""",
    "registration_outcomes": """
        SELECT r.*, CASE WHEN NOT valid THEN 'invalid'
                 WHEN EXISTS (SELECT 1 FROM protocols p WHERE lower(p.address) = lower(r.address)) THEN 'exists'
                 WHEN row_number() OVER (PARTITION BY valid, lower(address) ORDER BY request_id) > 1
                      THEN 'repeated in batch'
                 ELSE 'accepted' END AS outcome
        FROM (SELECT *, length(name) BETWEEN 1 AND 120
                        AND regexp_full_match(address, '0x[a-fA-F0-9]{40}') AS valid FROM registrations) r""",
    "applications": """
        SELECT c_custkey AS request_id,
               CASE WHEN c_custkey % 3 = 0 THEN upper(c_name || '@' || c_mktsegment || '.example')
                    WHEN c_custkey % 31 = 0 THEN 'no address'
                    ELSE 'Applicant' || (c_custkey % 400) || '@new.example' END AS email,
               c_name AS name, CASE WHEN c_custkey % 29 = 0 THEN repeat('x', 161) ELSE c_mktsegment END AS project
        FROM customer""",
    "application_outcomes": """
        SELECT r.*, CASE WHEN NOT valid THEN 'invalid'
                 WHEN EXISTS (SELECT 1 FROM waitlist w WHERE lower(w.email) = lower(r.email)) THEN 'exists'
                 WHEN row_number() OVER (PARTITION BY valid, lower(email) ORDER BY request_id) > 1
                      THEN 'repeated in batch'
                 ELSE 'accepted' END AS outcome
        FROM (SELECT *, contains(email, '@') AND length(project) <= 160 AS valid FROM applications) r""",
    "decisions": """
        SELECT event_id AS decision_id, event_id % 2000 AS waitlist_id,
               CASE WHEN event_type = 'signup' THEN 'approve' ELSE 'reject' END AS action,
               CASE WHEN event_type = 'signup' THEN user_id END AS api_key_id, ts AS decided_at
        FROM events WHERE event_type IN ('signup', 'error')""",
    "decision_outcomes": """
        SELECT d.*, CASE WHEN w.id IS NULL THEN 'not found'
                 WHEN d.action = 'approve' AND (w.status = 'rejected' OR coalesce(sum(CASE WHEN d.action = 'reject' THEN 1 ELSE 0 END)
                      OVER (PARTITION BY d.waitlist_id ORDER BY d.decided_at, d.decision_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0) THEN 'already rejected'
                 ELSE 'done' END AS outcome
        FROM decisions d LEFT JOIN waitlist w ON w.id = d.waitlist_id""",
    "flagged": """
        SELECT '0x' || lpad(lower(hex(s_suppkey + 100)), 40, '0') AS address FROM supplier WHERE s_acctbal < 1000""",
    "calls": """
        SELECT id, api_key_id, created_at, epoch_us(created_at) AS us FROM request_log WHERE api_key_id IS NOT NULL""",
    "head": "SELECT max(block_number) AS head FROM raw_tx",
    "windows": """
        SELECT id AS protocol_id, address, created_at AS protocol_created_at, seen + 1 AS from_block,
               least(head, seen + 5) AS to_block
        FROM (SELECT *, CASE WHEN last_seen_block = 0 THEN head - 10 ELSE last_seen_block END AS seen
              FROM protocols, head WHERE is_active)
        WHERE seen + 1 <= least(head, seen + 5)""",
}
_WITH = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items()) + "\n"

_ALERT_FEED = """
    SELECT a.id, a.transaction_id, t.tx_hash, p.name AS protocol_name, a.risk_score, a.risk_summary,
           a.telegram_sent, a.created_at
    FROM alerts a JOIN transactions t ON t.id = a.transaction_id JOIN protocols p ON p.id = t.protocol_id
    ORDER BY a.created_at DESC, a.id DESC LIMIT {n}"""
_BAND = """CASE WHEN risk_score IS NULL THEN 'PENDING' WHEN risk_score <= 30 THEN 'LOW'
    WHEN risk_score <= 60 THEN 'MEDIUM' WHEN risk_score <= 70 THEN 'ELEVATED' ELSE 'HIGH' END"""
_TX_VIEW = "id, tx_hash, from_address, to_address, value_eth, risk_score, risk_summary, fetched_at"
_SHORT = "left({c}, 10) || '...' || right({c}, 6)"
_KEY_VIEW = "id, key_prefix, name, is_active, requests_today, requests_total, last_used_at, created_at"
_ROW = "md5({k})[1:3], {k}"
_MESSAGE = (
    "'<b>🚨 New Risk Alert 🚨</b>' || chr(10) || chr(10) || '<b>Protocol:</b> ' || "
    "{name} || chr(10) || '<b>Score:</b> <code>' || {score} || '</code>' "
    "|| chr(10) || '<b>TX:</b> <code>' || {hash} || '</code>'"
)


def _limiter(per_minute: int, per_day: int, minute: int, day: int) -> str:
    """Fold the calls of each key in order into the list of admitted ones, then look up every call."""
    step = (
        "lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.us > x[1].us - {m})) < {pm} "
        "AND len(list_filter(acc, lambda a: a.us > x[1].us - {d})) < {pd} THEN list_append(acc, x[1]) ELSE acc END"
    ).format(m=minute * 10**6, d=day * 10**6, pm=per_minute, pd=per_day)
    return f"""
    , folded AS (
        SELECT api_key_id, list_reduce(list([{{'us': us, 'id': id}}] ORDER BY us, id), {step}) AS admitted
        FROM calls GROUP BY api_key_id),
    admitted AS (SELECT api_key_id, u.us AS us, u.id AS id FROM (SELECT api_key_id, unnest(admitted) AS u FROM folded)),
    seen AS (
        SELECT c.api_key_id, c.id, c.created_at, c.us,
               max(CASE WHEN a.id = c.id THEN 1 ELSE 0 END) = 1 AS allowed,
               count(a.id) FILTER (WHERE a.us > c.us - {minute * 10**6} AND (a.us, a.id) < (c.us, c.id)) AS in_minute,
               min(a.us) FILTER (WHERE a.us > c.us - {minute * 10**6} AND (a.us, a.id) < (c.us, c.id)) AS oldest
        FROM calls c LEFT JOIN admitted a ON a.api_key_id = c.api_key_id AND (a.us, a.id) <= (c.us, c.id)
        GROUP BY ALL),
    reset AS (
        SELECT *, CASE WHEN NOT allowed AND in_minute >= {per_minute} THEN oldest + {minute * 10**6}
                       ELSE us + {minute * 10**6} END // 1000000 AS reset_at
        FROM seen)
    SELECT api_key_id, id, created_at, allowed,
           CAST(CASE WHEN allowed THEN {per_minute} - in_minute - 1 ELSE 0 END AS INTEGER) AS remaining, reset_at,
           CAST(CASE WHEN allowed THEN 0 ELSE greatest(reset_at - us // 1000000, 1) END AS INTEGER) AS retry_after
    FROM reset"""


_STREAM_SCORES = """
    , landed AS (
        SELECT w.*, coalesce(s.risk_score, 50) AS risk_score,
               coalesce(s.risk_summary, 'Scoring unavailable') AS risk_summary
        FROM active_writers w LEFT JOIN scores s ON s.tx_hash = w.tx_hash)"""
_RULES = """
    SELECT tx_hash, CAST(least(100, greatest(0, 20
        + CASE WHEN value_eth >= 100 THEN 15 ELSE 0 END + CASE WHEN value_eth >= 300 THEN 20 ELSE 0 END
        + CASE WHEN length(input_data) > 60 THEN 10 ELSE 0 END
        + CASE WHEN left(input_data, 10) = '0x' || left(sha256('1-URGENT'), 8) THEN 30 ELSE 0 END
        + CASE WHEN gas_used >= 300000 THEN 10 ELSE 0 END
        + CASE WHEN gas_used >= 300000 AND value_eth < 1 THEN 5 ELSE 0 END
        + CASE WHEN input_data NOT IN ('', '0x') THEN 5 ELSE 0 END
        + CASE WHEN from_address IN (SELECT address FROM flagged) THEN 40 ELSE 0 END
        + CASE WHEN count(*) OVER (PARTITION BY from_address) <= 5 THEN 10 ELSE 0 END
        + CASE WHEN hour(fetched_at) BETWEEN 0 AND 5 THEN 5 ELSE 0 END)) AS INTEGER) AS risk_score
    FROM transactions"""

_PROTOCOL_COLUMNS = "id, name, address, chain, is_active, last_seen_block, created_at"

QUERIES = {
    # Feeds, lists, lookups
    "recent_alerts": _ALERT_FEED.format(n=100),
    "alert_strip": f"SELECT id, risk_score, {_BAND} AS band, coalesce(nullif(risk_summary, ''), 'High risk transaction detected') AS text FROM ({_ALERT_FEED.format(n=12)})",
    "alert_range": f"SELECT * FROM ({_ALERT_FEED.format(n=200)}) WHERE risk_score BETWEEN 80 AND 90",
    "recent_transactions": f"SELECT {_TX_VIEW} FROM transactions ORDER BY fetched_at DESC, id DESC LIMIT 50",
    "protocol_transactions": f"SELECT {_TX_VIEW} FROM transactions WHERE protocol_id = 3 ORDER BY fetched_at DESC, id DESC LIMIT 200",
    "transaction_rows": f"""
        SELECT id, {_SHORT.format(c='tx_hash')} AS tx, {_SHORT.format(c='from_address')} AS sender,
               printf('%.5f', value_eth) AS value, risk_score, {_BAND} AS band,
               CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' ELSE (s // 3600) || 'h ago' END AS age
        FROM (SELECT *, greatest(0, (epoch_us(TIMESTAMP '{FEED_AS_OF}') - epoch_us(fetched_at)) // 1000000) AS s
              FROM transactions ORDER BY fetched_at DESC, id DESC LIMIT 50)""",
    "shown_transaction_count": "SELECT least(count(*), 50) AS transactions FROM transactions WHERE protocol_id = 3",
    "demo_feed": f"""
        SELECT id, {_SHORT.format(c='tx_hash')} AS tx, printf('%.3f', value_eth) AS value, risk_score, {_BAND} AS band
        FROM transactions ORDER BY fetched_at DESC, id DESC LIMIT 10""",
    "protocol_list": f"SELECT {_PROTOCOL_COLUMNS} FROM protocols",
    "active_protocols": f"SELECT {_PROTOCOL_COLUMNS} FROM protocols WHERE is_active",
    "shown_protocol": f"SELECT {_PROTOCOL_COLUMNS} FROM protocols ORDER BY is_active DESC, created_at DESC, id DESC LIMIT 1",
    "protocol_by_id": f"SELECT {_PROTOCOL_COLUMNS} FROM protocols WHERE id = 7",
    "protocol_lookup": f"SELECT {_PROTOCOL_COLUMNS} FROM protocols WHERE lower(address) = '0x' || lpad('b0', 40, '0')",
    "tx_lookup": f"SELECT {_TX_VIEW} FROM transactions WHERE tx_hash = '0x' || sha256('42')",
    "key_lookup": f"SELECT {_KEY_VIEW} FROM api_keys WHERE key_hash = sha256('key-7') AND is_active",
    "waitlist_lookup": "SELECT id, email, status FROM waitlist WHERE lower(email) = (SELECT lower(email) FROM waitlist WHERE id = 7)",
    "key_list": f"SELECT {_KEY_VIEW} FROM api_keys",
    "top_keys": "SELECT key_prefix, name, requests_today FROM api_keys ORDER BY requests_today DESC, id LIMIT 10",
    "waitlist_list": "SELECT * FROM waitlist",
    # Statistics
    "alert_stats": f"""
        SELECT count(CASE WHEN date_trunc('day', created_at) = DATE '{ALERTS_AS_OF[:10]}' THEN 1 END) AS today,
               count(CASE WHEN TIMESTAMP '{ALERTS_AS_OF}' - created_at <= INTERVAL 7 DAY THEN 1 END) AS this_week,
               count(id) AS all_time
        FROM alerts""",
    "public_stats": """
        FROM (SELECT count(CASE WHEN is_active THEN 1 END) AS protocols_monitored FROM protocols),
             (SELECT count(risk_score) AS transactions_scored FROM transactions),
             (SELECT count(id) AS alerts_fired, 1 AS uptime_days FROM alerts)""",
    "admin_overview": f"""
        FROM (SELECT count(id) AS total_api_keys, count(CASE WHEN is_active THEN 1 END) AS active_api_keys FROM api_keys),
             (SELECT count(CASE WHEN status = 'pending' THEN 1 END) AS waitlist_pending FROM waitlist),
             (SELECT count(id) AS protocols_monitored FROM protocols),
             (SELECT count(risk_score) AS transactions_scored_total FROM transactions),
             (SELECT count(id) AS alerts_fired_total FROM alerts),
             (SELECT count(CASE WHEN date_trunc('day', created_at) = DATE '{LOG_AS_OF[:10]}' THEN 1 END) AS requests_today FROM request_log)""",
    "requests_today": f"SELECT count(*) AS requests_today FROM request_log WHERE CAST(created_at AS DATE) = DATE '{LOG_AS_OF[:10]}'",
    "risk_histogram": """
        SELECT count(CASE WHEN risk_score <= 30 THEN 1 END) AS low_0_30, count(CASE WHEN risk_score > 30 AND risk_score <= 60 THEN 1 END) AS medium_31_60,
               count(CASE WHEN risk_score > 60 AND risk_score <= 70 THEN 1 END) AS elevated_61_70, count(CASE WHEN risk_score > 70 THEN 1 END) AS high_71_100
        FROM transactions""",
    "risk_bands": f"SELECT {_BAND} AS band, count(*) AS transactions FROM transactions GROUP BY 1",
    "daily_requests": f"""
        SELECT strftime(DATE '{LOG_AS_OF[:10]}' - n, '%Y-%m-%d') AS date,
               (SELECT count(l.id) FROM request_log l WHERE date_trunc('day', l.created_at) = DATE '{LOG_AS_OF[:10]}' - n) AS requests
        FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS n)""",
    "waitlist_counts": """
        SELECT count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'approved' THEN 1 END) AS approved,
               count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected
        FROM waitlist""",
    "waitlist_domains": "SELECT split_part(email, '@', 2) AS domain, count(*) AS applications FROM waitlist GROUP BY 1",
    # Request log and keys
    "key_usage": f"""
        SELECT k.id, k.requests_today + coalesce(n, 0) AS requests_today, k.requests_total + coalesce(n, 0) AS requests_total,
               greatest(k.last_used_at, u.last) AS last_used_at
        FROM api_keys k LEFT JOIN (SELECT api_key_id, count(*) AS n, max(created_at) AS last FROM request_log
             WHERE api_key_id IS NOT NULL GROUP BY 1) u ON u.api_key_id = k.id""",
    "key_usage_of_day": f"""
        SELECT k.id, coalesce(d, 0) AS requests_today, k.requests_total + coalesce(n, 0) AS requests_total
        FROM api_keys k LEFT JOIN (SELECT api_key_id, count(*) AS n,
             count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '{LOG_AS_OF[:10]}') AS d FROM request_log
             WHERE api_key_id IS NOT NULL GROUP BY 1) u ON u.api_key_id = k.id""",
    "key_usage_daily": """
        SELECT api_key_id, CAST(created_at AS DATE) AS day, count(*) AS requests FROM request_log
        WHERE api_key_id IS NOT NULL GROUP BY 1, 2""",
    "validate_keys": """
        SELECT e.event_id AS request_id, k.id IS NOT NULL AS valid, k.key_prefix, k.id, k.name
        FROM events e LEFT JOIN api_keys k ON k.is_active AND k.id = e.user_id * 2""",
    "authenticate_keys": """
        SELECT e.event_id AS request_id, k.id IS NOT NULL AS valid, k.key_prefix, k.id, k.name
        FROM events e LEFT JOIN api_keys k ON k.is_active AND k.id = e.user_id * 2 AND e.event_type <> 'click'""",
    "revoke_keys": """
        SELECT id, is_active AND id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS is_active FROM api_keys""",
    "revocation_outcomes": """
        SELECT c_custkey AS key_id, c_custkey IN (SELECT id FROM api_keys) AS found FROM customer WHERE c_acctbal < 0""",
    "add_keys": f"""
        SELECT (SELECT max(id) FROM api_keys) + row_number() OVER (ORDER BY {_ROW.format(k='key_hash')}) AS id,
               key_hash, left('key-' || n, 9) AS key_prefix, name, true AS is_active, CAST(0 AS BIGINT) AS requests_total
        FROM (SELECT s_suppkey * 3 AS n, sha256('key-' || (s_suppkey * 3)) AS key_hash, s_name AS name FROM supplier)
        WHERE key_hash NOT IN (SELECT key_hash FROM api_keys)""",
    "offered_load": """
        SELECT id, api_key_id,
               count(*) OVER (PARTITION BY api_key_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS last_minute,
               count(*) OVER (PARTITION BY api_key_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS last_day
        FROM calls""",
    "rate_limit_audit": _limiter(1, 5, 3600, 86400),
    "rate_limit_defaults": _limiter(60, 5000, 60, 86400),
    "stream_rate_limit": _limiter(1, 5, 3600, 86400),
    "append_requests": """
        SELECT CAST(created_at AS DATE) AS day, count(*) AS requests FROM raw_requests WHERE endpoint LIKE '/api%' GROUP BY 1""",
    "clean_routes": """
        SELECT CASE WHEN endpoint = '/api/index' THEN '/api/health'
                    ELSE replace(replace(endpoint, '/api/index.py/', '/api/'), '/api/index/', '/api/') END AS route,
               method, count(*) AS requests
        FROM raw_requests GROUP BY 1, 2""",
    "log_events": """
        SELECT id, created_at AS ts, CASE WHEN status_code = 429 THEN 'WARNING' ELSE 'INFO' END AS level,
               'hexwarden' AS service, 'api.request' AS event, endpoint, response_ms AS duration_ms FROM request_log""",
    "log_lines": """
        SELECT id, '{"ts":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') ||
               CASE WHEN epoch_us(created_at) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(created_at) % 1000000 AS VARCHAR), 6, '0') END
               || 'Z","level":"' || CASE WHEN status_code = 429 THEN 'WARNING' ELSE 'INFO' END
               || '","service":"hexwarden","event":"api.request","id":' || id || ',"endpoint":"' || endpoint
               || '","duration_ms":' || response_ms || '}' AS line FROM request_log""",
    # Chain data
    "landed_transactions": "SELECT * EXCLUDE (pos) FROM decoded",
    "head_block": "SELECT head FROM head",
    "landed_head": "SELECT head FROM head",
    "decode_transactions": "SELECT * EXCLUDE (pos) FROM decoded",
    "match_transactions": "SELECT tx_hash, protocol_id, block_number, value_eth, gas_used FROM matched",
    "first_writer": "SELECT tx_hash, protocol_id, block_number FROM first_writers",
    "insert_transactions": f"""
        SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY {_ROW.format(k='tx_hash')}) AS id,
               protocol_id, tx_hash, block_number, from_address, to_address, value_eth, gas_used, input_data
        FROM first_writers WHERE tx_hash NOT IN (SELECT tx_hash FROM stored)""",
    "insert_outcomes": f"""
        SELECT f.tx_hash, s.id IS NULL AS is_new, coalesce(s.id, (SELECT max(id) FROM stored)
               + row_number() OVER (PARTITION BY s.id IS NULL ORDER BY {_ROW.format(k='f.tx_hash')})) AS id
        FROM first_writers f LEFT JOIN stored s ON s.tx_hash = f.tx_hash""",
    "poll_windows": "SELECT protocol_id, address, from_block, to_block FROM windows",
    "window_transactions": """
        SELECT m.tx_hash, m.protocol_id, m.block_number FROM matched m JOIN windows w ON w.protocol_id = m.protocol_id
        WHERE m.block_number BETWEEN w.from_block AND w.to_block""",
    "advance_cursor": "SELECT p.id, coalesce(w.to_block, p.last_seen_block) AS last_seen_block FROM protocols p LEFT JOIN windows w ON w.protocol_id = p.id",
    "backfill_new_protocol": """
        SELECT tx_hash, protocol_id, block_number, gas_used FROM matched, head
        WHERE is_active AND block_number BETWEEN head - 9 AND head""",
    "landed_backfill": """
        SELECT tx_hash, protocol_id, block_number, gas_used FROM matched, head
        WHERE is_active AND block_number BETWEEN head - 9 AND head""",
    # Scores and alerts
    "parse_scores": "SELECT id, tx_hash, risk_score, risk_summary, risk_factors FROM scores",
    "resolve_scores": """
        SELECT t.tx_hash, coalesce(s.risk_score, 50) AS risk_score, coalesce(s.risk_summary, 'Scoring unavailable') AS risk_summary,
               coalesce(s.risk_factors, 'Scoring failed') AS risk_factors
        FROM transactions t LEFT JOIN scores s ON s.tx_hash = t.tx_hash""",
    "apply_scores": f"""
        SELECT t.id, CASE WHEN s.id IS NULL THEN t.risk_score ELSE s.risk_score END AS risk_score,
               CASE WHEN s.id IS NULL THEN t.risk_summary ELSE s.risk_summary END AS risk_summary,
               CASE WHEN s.id IS NULL THEN NULL ELSE TIMESTAMP '{ALERTS_AS_OF}' END AS scored_at
        FROM transactions t LEFT JOIN scores s ON s.tx_hash = t.tx_hash""",
    "rescore": f"""
        SELECT t.id, CASE WHEN e.event_id IS NULL THEN t.risk_score ELSE s.risk_score END AS risk_score,
               CASE WHEN e.event_id IS NULL THEN NULL ELSE TIMESTAMP '{ALERTS_AS_OF}' END AS scored_at
        FROM transactions t LEFT JOIN events e ON e.event_id = t.id AND e.event_type = 'purchase'
        LEFT JOIN scores s ON s.id = t.id""",
    "unscored_requests": """
        SELECT t.id, t.tx_hash, 'Watched contract: ' || coalesce(p.name, 'unknown') || ' at ' || coalesce(p.address, 'unknown')
               || chr(10) || 'Hash: ' || t.tx_hash || chr(10) || 'Sender: ' || t.from_address
               || chr(10) || 'Recipient: ' || coalesce(t.to_address, 'unknown')
               || chr(10) || 'Amount in ETH: ' || CAST(t.value_eth AS VARCHAR) || chr(10) || 'Gas: ' || t.gas_used
               || chr(10) || 'Call data: ' || t.input_data || chr(10) || 'Block number: ' || t.block_number AS request
        FROM transactions t LEFT JOIN protocols p ON p.id = t.protocol_id WHERE t.risk_score IS NULL""",
    "rule_scores": _RULES,
    "new_alerts": f"""
        SELECT (SELECT max(id) FROM alerts) + row_number() OVER (ORDER BY {_ROW.format(k='CAST(transaction_id AS VARCHAR)').replace(', CAST(transaction_id AS VARCHAR)', ', transaction_id')}) AS id,
               transaction_id, risk_score, risk_summary, telegram_sent, created_at
        FROM (SELECT t.id AS transaction_id, s.risk_score, s.risk_summary, false AS telegram_sent,
                     TIMESTAMP '{ALERTS_AS_OF}' AS created_at
              FROM transactions t JOIN scores s ON s.tx_hash = t.tx_hash
              WHERE t.risk_score IS NULL AND s.risk_score >= 70)""",
    "alert_outbox": f"""
        SELECT a.id AS alert_id, t.tx_hash, {_MESSAGE.format(name='p.name', score='a.risk_score', hash='t.tx_hash')} AS message
        FROM alerts a JOIN transactions t ON t.id = a.transaction_id LEFT JOIN protocols p ON p.id = t.protocol_id
        WHERE NOT a.telegram_sent""",
    "mark_delivered": """
        SELECT id, telegram_sent OR id IN (SELECT event_id FROM events WHERE event_type = 'purchase') AS telegram_sent FROM alerts""",
    "monitor_events": """
        SELECT '{"ts":"' || strftime(t.fetched_at, '%Y-%m-%dT%H:%M:%SZ') || '","level":"INFO","service":"hexwarden","event":"'
               || CASE k WHEN 0 THEN 'transaction.fetched' WHEN 1 THEN 'transaction.scored' ELSE 'alert.created' END || '",'
               || CASE WHEN k < 2 THEN '"protocol":"' || p.name || '","tx_hash":"' || left(t.tx_hash, 18)
                            || CASE k WHEN 0 THEN '","block_number":' || t.block_number ELSE '","risk_score":' || t.risk_score END
                       ELSE '"alert_id":' || t.id || ',"risk_score":' || t.risk_score || ',"tx_hash":"' || left(t.tx_hash, 18) || '"' END
               || '}' AS line
        FROM transactions t JOIN protocols p ON p.id = t.protocol_id, (SELECT unnest([0, 1, 2]) AS k)
        WHERE k = 0 OR (k = 1 AND t.risk_score >= 50) OR (k = 2 AND t.risk_score >= 70)""",
    "delivery_events": """
        SELECT '{"ts":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '","level":"' || CASE WHEN sent THEN 'INFO' ELSE 'WARNING' END
               || '","service":"hexwarden","event":"alert.telegram.' || CASE WHEN sent THEN 'sent' ELSE 'failed' END
               || '","alert_id":' || id || '}' AS line
        FROM (SELECT *, id IN (SELECT event_id FROM events WHERE event_type = 'purchase') AS sent FROM alerts WHERE NOT telegram_sent)""",
    # Registries
    "protocol_registration": "SELECT request_id, address, outcome FROM registration_outcomes",
    "register_protocols": f"""
        SELECT (SELECT max(id) FROM protocols) + row_number() OVER (ORDER BY {_ROW.format(k='lower(address)')}) AS id,
               name, address, 'ethereum' AS chain, true AS is_active
        FROM registration_outcomes WHERE outcome = 'accepted'""",
    "protocol_toggle": """
        SELECT p.id, p.is_active <> (coalesce(n, 0) % 2 = 1) AS is_active FROM protocols p
        LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) c ON c.user_id = p.id""",
    "delete_protocols": f"SELECT {_PROTOCOL_COLUMNS} FROM protocols WHERE id NOT IN (SELECT r_regionkey FROM region)",
    "delete_protocols_transactions": "SELECT id, protocol_id, tx_hash FROM transactions WHERE protocol_id NOT IN (SELECT r_regionkey FROM region)",
    "delete_protocols_alerts": """
        SELECT a.id, a.transaction_id, a.risk_score FROM alerts a JOIN transactions t ON t.id = a.transaction_id
        WHERE t.protocol_id NOT IN (SELECT r_regionkey FROM region)""",
    "waitlist_applications": "SELECT request_id, email, outcome FROM application_outcomes",
    "add_applications": f"""
        SELECT (SELECT max(id) FROM waitlist) + row_number() OVER (ORDER BY {_ROW.format(k='lower(email)')}) AS id,
               email, name, project, 'pending' AS status
        FROM application_outcomes WHERE outcome = 'accepted'""",
    "decision_outcomes": "SELECT decision_id, outcome FROM decision_outcomes",
    "waitlist_decisions": """
        SELECT w.id, CASE WHEN d.n IS NULL THEN w.status WHEN d.rejects > 0 THEN 'rejected' ELSE 'approved' END AS status,
               coalesce(d.key, w.api_key_id) AS api_key_id, coalesce(d.last, w.reviewed_at) AS reviewed_at
        FROM waitlist w LEFT JOIN (
            SELECT waitlist_id, count(*) AS n, count(*) FILTER (WHERE action = 'reject') AS rejects,
                   last(api_key_id ORDER BY decided_at, decision_id) FILTER (WHERE action = 'approve') AS key,
                   max(decided_at) AS last
            FROM decision_outcomes WHERE outcome = 'done' GROUP BY 1) d ON d.waitlist_id = w.id""",
    # Streams
    "stream_ingest": _STREAM_SCORES + "SELECT tx_hash, protocol_id, block_number, value_eth, gas_used, risk_score, risk_summary FROM landed",
    "stream_alerts": _STREAM_SCORES + f"""
        SELECT l.tx_hash, l.risk_score, {_MESSAGE.format(name='p.name', score='l.risk_score', hash='l.tx_hash')} AS message
        FROM landed l JOIN protocols p ON p.id = l.protocol_id WHERE l.risk_score >= 70""",
    "stream_cursor": """
        SELECT id, CASE WHEN is_active THEN greatest(last_seen_block, (SELECT max(block_number) FROM raw_tx)) ELSE last_seen_block END
               AS last_seen_block FROM protocols""",
    "stream_events": _STREAM_SCORES + """
        SELECT 'transaction.fetched' AS event, count(*) AS lines FROM landed
        UNION ALL SELECT 'transaction.scored', count(*) FROM landed
        UNION ALL SELECT 'alert.created', count(*) FROM landed WHERE risk_score >= 70""",
    "stream_runs": _STREAM_SCORES + """
        SELECT (SELECT count(DISTINCT block_number) FROM raw_tx) AS blocks, count(*) AS transactions_found,
               count(*) FILTER (WHERE risk_score >= 70) AS alerts_fired,
               (SELECT count(*) FROM protocols WHERE is_active) AS protocols_checked FROM landed""",
}


def oracle_sql() -> dict[str, str]:
    return {
        name: _WITH.rstrip() + (body if body.lstrip().startswith(",") else "\n" + body) for name, body in QUERIES.items()
    }
