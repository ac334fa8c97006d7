"""Protocols, waitlist and keys as change batches."""

import hashlib
import random

from pyspark.sql import functions as F

from hexwarden import schemas
from hexwarden.operators import keys, registry, waitlist


def _protocols(spark):
    rows = [(1, "A", "0x" + "a" * 40, True), (2, "B", "0x" + "B" * 40, False), (3, "C", "0x" + "c" * 40, True)]
    df = spark.createDataFrame(rows, "id bigint, name string, address string, is_active boolean")
    return df.selectExpr(
        "id", "name", "address", "'ethereum' AS chain", "is_active", "cast(null as bigint) AS last_seen_block",
        "timestamp'2024-01-01' AS created_at",
    )


def test_registration(spark):
    new = "0x" + "d" * 40
    batch = spark.createDataFrame(
        [
            (1, "a again", "0x" + "A" * 40), (2, "bad", "0x123"), (3, "", new), (4, "first", new.upper().replace("X", "x")),
            (5, "second", new), (6, "line break", "0x" + "e" * 40 + "\n"), (7, "other", "0x" + "f" * 40),
        ],
        "request_id int, name string, address string",
    )
    got = {r.request_id: r.outcome for r in registry.registration_outcomes(batch, _protocols(spark)).collect()}
    assert got == {
        1: "exists", 2: "invalid", 3: "invalid", 4: "accepted", 5: "repeated in batch", 6: "invalid", 7: "accepted",
    }
    rows = registry.register_protocols(batch, _protocols(spark), "2024-02-01 00:00:00").collect()
    assert sorted(r.name for r in rows) == ["first", "other"] and sorted(r.id for r in rows) == [4, 5]
    assert all(r.is_active and r.chain == "ethereum" and r.last_seen_block is None for r in rows)


def test_toggle(spark):
    toggles = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,), (99,)], "protocol_id bigint")
    got = {r.id: r.is_active for r in registry.toggle_protocols(_protocols(spark), toggles).collect()}
    assert got == {1: False, 2: False, 3: False}


def test_delete_cascades(spark):
    transactions = spark.createDataFrame([(10, 1), (11, 2), (12, 1)], "id bigint, protocol_id bigint")
    alerts = spark.createDataFrame([(5, 10), (6, 11), (7, 10), (8, 12)], "id bigint, transaction_id bigint")
    gone = spark.createDataFrame([(1,), (1,), (42,)], "protocol_id bigint")
    kept = registry.delete_protocols(_protocols(spark), transactions, alerts, gone)
    assert [sorted(r.id for r in df.collect()) for df in kept] == [[2, 3], [11], [6]]


def _waitlist(spark):
    rows = [(1, "A@x.io", "pending", None), (2, "b@x.io", "approved", 7), (3, "c@x.io", "rejected", None)]
    df = spark.createDataFrame(rows, "id bigint, email string, status string, api_key_id bigint")
    for c in ("name", "project", "twitter"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("applied_at", F.lit("2024-01-01").cast("timestamp"))
    return df.withColumn("reviewed_at", F.lit(None).cast("timestamp")).select(*schemas.WAITLIST.fieldNames())


def test_applications(spark):
    batch = spark.createDataFrame(
        [(1, "a@X.IO", "n", "g"), (2, "new@y.io", "n", "g"), (3, "NEW@y.io", "n", "g"), (4, "nobody", "n", "g"), (5, "z@y.io", "n", "g" * 1001)],
        "request_id int, email string, name string, goal string",
    )
    got = {r.request_id: r.outcome for r in waitlist.application_outcomes(batch, _waitlist(spark)).collect()}
    assert got == {1: "exists", 2: "accepted", 3: "repeated in batch", 4: "invalid", 5: "invalid"}
    (row,) = waitlist.add_applications(batch, _waitlist(spark)).collect()
    assert (row.id, row.email, row.status) == (4, "new@y.io", "pending") and "goal" not in row.asDict()


def _replay_decisions(rows, decisions):
    state, outcomes = {r[0]: [r[2], r[3]] for r in rows}, {}
    for decision_id, target, action, key, _ in sorted(decisions, key=lambda d: (d[4], d[0])):
        if target not in state:
            outcomes[decision_id] = "not found"
        elif action == "approve" and state[target][0] == "rejected":
            outcomes[decision_id] = "already rejected"
        else:
            outcomes[decision_id] = "done"
            state[target][0] = "approved" if action == "approve" else "rejected"
            if action == "approve" and key is not None:
                state[target][1] = key
    return outcomes, {i: tuple(s) for i, s in state.items()}


def test_decisions_equal_a_replay(spark):
    rng = random.Random(5)
    stored = [(r.id, r.email, r.status, r.api_key_id) for r in _waitlist(spark).collect()]
    for _ in range(4):
        decisions = [
            (n, rng.randrange(1, 5), rng.choice(["approve", "approve", "reject"]), rng.choice([None, 100 + n]), f"2024-01-0{rng.randrange(1, 9)}")
            for n in range(12)
        ]
        df = spark.createDataFrame(decisions, "decision_id int, waitlist_id bigint, action string, api_key_id bigint, at string")
        df = df.withColumn("decided_at", F.to_timestamp("at")).drop("at")
        outcomes, state = _replay_decisions(stored, decisions)
        got = {r.decision_id: r.outcome for r in waitlist.decision_outcomes(_waitlist(spark), df).collect()}
        assert got == outcomes
        got = {r.id: (r.status, r.api_key_id) for r in waitlist.decide(_waitlist(spark), df).collect()}
        assert got == state


def _keys(spark):
    rows = [(n, hashlib.sha256(f"key-{n}".encode()).hexdigest(), "key-", f"user {n}", n != 3, 5, 5) for n in (1, 2, 3)]
    df = spark.createDataFrame(
        rows, "id bigint, key_hash string, key_prefix string, name string, is_active boolean, requests_today bigint, requests_total bigint"
    )
    df = df.withColumn("waitlist_id", F.lit(None).cast("bigint")).withColumn("last_used_at", F.lit("2024-01-01").cast("timestamp"))
    return df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).select(*schemas.API_KEYS.fieldNames())


def test_check_keys(spark):
    shown = spark.createDataFrame([("key-1",), (" key-2\n",), ("key-3",), ("nope",), (None,)], "api_key string")
    got = {r.api_key: (r.valid, r.id) for r in keys.check_keys(shown, _keys(spark)).collect()}
    assert got == {"key-1": (True, 1), " key-2\n": (True, 2), "key-3": (False, None), "nope": (False, None), None: (False, None)}
    got = {r.api_key: r.valid for r in keys.check_keys(shown, _keys(spark), strip_text=False).collect()}
    assert got[" key-2\n"] is False and got["key-1"] is True


def test_usage_counters(spark):
    log = spark.createDataFrame(
        [(1, "2024-01-30 10:00:00"), (1, "2024-01-29 10:00:00"), (None, "2024-01-30 11:00:00"), (2, "2023-01-01 00:00:00")],
        "api_key_id bigint, at string",
    ).withColumn("created_at", F.to_timestamp("at"))
    got = {r.id: r for r in keys.count_usage(_keys(spark), log).collect()}
    assert [(got[n].requests_today, got[n].requests_total) for n in (1, 2, 3)] == [(7, 7), (6, 6), (5, 5)]
    assert got[1].last_used_at.isoformat() == "2024-01-30T10:00:00" and got[2].last_used_at.year == 2024
    daily = {r.id: r for r in keys.count_usage(_keys(spark), log, "2024-01-30 23:00:00", daily=True).collect()}
    assert [(daily[n].requests_today, daily[n].requests_total) for n in (1, 2, 3)] == [(1, 7), (0, 6), (0, 5)]


def test_revoke_and_add(spark):
    gone = spark.createDataFrame([(1,), (1,), (9,)], "key_id bigint")
    assert {r.id: r.is_active for r in keys.revoke_keys(_keys(spark), gone).collect()} == {1: False, 2: True, 3: False}
    assert {r.key_id: r.found for r in keys.revocation_outcomes(_keys(spark), gone).collect()} == {1: True, 9: False}
    batch = spark.createDataFrame([("key-1", "again"), ("key_0123456789", "new"), ("key_0123456789", "new")], "api_key string, name string")
    (row,) = keys.add_keys(batch, _keys(spark), "2024-02-02 00:00:00").collect()
    assert (row.id, row.key_prefix, row.name, row.requests_total) == (4, "key_01234", "new", 0)
    assert row.key_hash == hashlib.sha256(b"key_0123456789").hexdigest()
