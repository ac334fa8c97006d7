"""Offered load and limiter against plain replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hexwarden.operators import limiter, load

START = datetime(2024, 1, 1)


def _calls(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, api_key_id bigint, us bigint")
    return df.withColumn("created_at", F.timestamp_micros("us")).drop("us")


def _random_rows(seed, n, keys, span_seconds, step=250_000):
    rng = random.Random(seed)
    base = int(START.timestamp()) * 10**6
    # Coarse steps give equal times and calls exactly a window apart.
    return [
        (i, rng.choice(keys), base + rng.randrange(span_seconds * 10**6 // step) * step) for i in range(n)
    ]


def _replay(rows, limits):
    """The limiter, one call after the other."""
    out, windows = {}, {}
    for i, key, now in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        minute, day = windows.setdefault(key, ([], []))
        minute[:] = [t for t in minute if t > now - limits.minute_seconds * 10**6]
        day[:] = [t for t in day if t > now - limits.day_seconds * 10**6]
        left, day_left = limits.per_minute - len(minute), limits.per_day - len(day)
        if left <= 0 or day_left <= 0:
            first = minute[0] if left <= 0 and minute else now
            reset = (first + limits.minute_seconds * 10**6) // 10**6
            out[i] = (False, 0, reset, max(reset - now // 10**6, 1))
        else:
            minute.append(now)
            day.append(now)
            out[i] = (True, left - 1, (now + limits.minute_seconds * 10**6) // 10**6, 0)
    return out


def _audit(spark, rows, limits, **options):
    decided = limiter.audit(_calls(spark, rows), limits, **options).collect()
    assert len(decided) == len(rows)
    return {r.id: (r.allowed, r.remaining, r.reset_at, r.retry_after) for r in decided}


@pytest.mark.parametrize("slot_seconds", [1, 7, 900])
def test_offered_load(spark, slot_seconds):
    rows = _random_rows(2, 600, [1, 1, 1, 2, 3], 400)
    df = load.offered_load(_calls(spark, rows), {"short": 5, "long": 60}, slot_seconds=slot_seconds)
    for r in df.collect():
        now = next(us for i, _, us in rows if i == r.id)
        for seconds, got in ((5, r.short), (60, r.long)):
            assert got == sum(k == r.api_key_id and now - seconds * 10**6 < us <= now for _, k, us in rows)


def test_offered_load_with_order_and_position(spark):
    rows = _random_rows(3, 300, [1, 2], 100)
    df = load.offered_load(_calls(spark, rows), {"n": 5}, tie_break="id", slot_seconds=3, sequence="position")
    for r in df.collect():
        now = next(us for i, _, us in rows if i == r.id)
        before = [(i, us) for i, k, us in rows if k == r.api_key_id and (us, i) <= (now, r.id)]
        assert r.position == len(before) and r.n == sum(us > now - 5 * 10**6 for _, us in before)


@pytest.mark.parametrize(
    "limits",
    [
        limiter.Limits(2, 10, 5, 60), limiter.Limits(1, 3, 5, 50), limiter.Limits(3, 3, 5, 60), limiter.Limits(0, 5, 5, 60),
        limiter.Limits(5, 0, 5, 60), limiter.Limits(100, 400, 5, 60),
    ],
)
def test_audit_equals_replay(spark, limits):
    rows = _random_rows(4, 500, [1, 1, 1, 1, 2, 3], 300)
    assert _audit(spark, rows, limits) == _replay(rows, limits)


@pytest.mark.parametrize("seed", range(4))
def test_audit_by_stretches(spark, seed):
    # Bursts with pauses of all lengths: shorter than the minute, between minute and day, longer than the day.
    rng, rows, now = random.Random(seed), [], int(START.timestamp()) * 10**6
    for _ in range(60):
        now += rng.choice([1, 3, 5, 12, 30, 61, 150]) * 10**6
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows), rng.choice([1, 1, 1, 2]), now))
            now += rng.choice([0, 250_000, 10**6])
    for limits in (limiter.Limits(2, 9, 5, 60), limiter.Limits(4, 12, 5, 60), limiter.Limits(3, 50, 5, 60), limiter.Limits(9, 4, 60, 5)):
        assert _audit(spark, rows, limits) == _replay(rows, limits)


def test_busy_key_is_replayed_in_many_stretches(spark):
    # One key with nine tenths of all calls: forty bursts over the minute limit, three of them over the day's.
    base, day = int(START.timestamp()) * 10**6, 86_400 * 10**6
    times = [base + n * day // 4 + i * 500_000 for n in range(40) for i in range(90)]
    times += [base + (30 + 3 * n) * day + i * 500_000 for n in range(3) for i in range(600)]
    rows = [(i, 1, at) for i, at in enumerate(times)]
    rows += [(len(times) + i, 2 + i % 50, base + i * 10**9) for i in range(len(times) // 10)]
    limits = limiter.Limits(60, 500, 60, 86_400)
    loads = load.offered_load(
        _calls(spark, rows), {"minute_load": 60, "day_load": 86_400}, tie_break="id"
    ).withColumn("at", F.unix_micros("created_at"))
    ranges = limiter.stretches(loads, limits, "api_key_id")
    tasks = limiter.replay_rows(loads, ranges, limits, "api_key_id", "id").groupBy("api_key_id", "start").count().collect()
    assert len(tasks) == 43 and max(r["count"] for r in tasks) <= 600
    assert _audit(spark, rows, limits) == _replay(rows, limits)


def test_day_over_without_a_pause_is_one_stretch(spark):
    base = int(START.timestamp()) * 10**6
    rows = [(i, 1, base + i * 700_000) for i in range(600)]
    limits = limiter.Limits(3, 20, 5, 60)
    loads = load.offered_load(
        _calls(spark, rows), {"minute_load": 5, "day_load": 60}, tie_break="id"
    ).withColumn("at", F.unix_micros("created_at"))
    assert limiter.stretches(loads, limits, "api_key_id").count() == 1
    assert _audit(spark, rows, limits) == _replay(rows, limits)


def test_audit_over_small_arrow_batches(spark):
    rows = _random_rows(6, 400, [1, 2], 200)
    limits = limiter.Limits(2, 9, 5, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _audit(spark, rows, limits) == _replay(rows, limits)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    base = int(START.timestamp()) * 10**6
    minute = 60 * 10**6
    # Exactly one window later the first call no longer counts; a refused call is never counted.
    rows = [(1, 1, base), (2, 1, base + minute - 1), (3, 1, base + minute), (4, 1, base + 2 * minute - 1)]
    got = _audit(spark, rows, limiter.Limits(per_minute=1, per_day=100))
    assert [got[i][0] for i in (1, 2, 3, 4)] == [True, False, True, False]
    # The day is full while the minute is free: the wait shown is that of the minute window.
    rows = [(n, 1, base + n * 2 * minute) for n in range(4)]
    got = _audit(spark, rows, limiter.Limits(per_minute=5, per_day=3))
    assert got[3] == (False, 0, (base + 7 * minute) // 10**6, 60)


def test_remaining_counts_down(spark):
    base = int(START.timestamp()) * 10**6
    got = _audit(spark, [(1, 1, base), (2, 1, base)], limiter.Limits(per_minute=2, per_day=10))
    assert [got[i][1] for i in (1, 2)] == [1, 0]


def test_calls_without_key_are_left_out(spark):
    calls = _calls(spark, [(1, None, 0), (2, 1, 0)])
    assert [r.id for r in limiter.audit(calls).collect()] == [2]


def test_text_keys(spark):
    rows = _random_rows(8, 200, [1, 2], 100)
    limits = limiter.Limits(2, 9, 5, 60)
    calls = _calls(spark, rows).withColumn("api_key_id", F.concat(F.lit("key-"), "api_key_id"))
    got = {r.id: r.allowed for r in limiter.audit(calls, limits).collect()}
    assert got == {i: r[0] for i, r in _replay(rows, limits).items()}


def test_times_survive(spark):
    rows = [(1, 1, int((START + timedelta(microseconds=123456)).timestamp() * 10**6))]
    (row,) = limiter.audit(_calls(spark, rows)).collect()
    assert row.created_at.microsecond == 123456
