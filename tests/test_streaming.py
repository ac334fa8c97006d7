"""The streams: batch by batch the same rows as a batch job, also when batches or files come again."""

import json
import os
import random
from datetime import datetime

from pyspark.sql import functions as F

from hexwarden import schemas
from hexwarden.operators import limiter
from hexwarden.sources import chain, eventlog, tables
from hexwarden.streaming import ingest, limits

WATCHED = {1: "0x" + "a" * 40, 2: "0x" + "b" * 40, 3: "0x" + "c" * 40}


def _tx(block, n, to, sender="0x" + "d" * 40):
    return {
        "hash": f"0x{block:04x}{n:04x}", "blockNumber": hex(block), "from": sender, "to": to, "value": hex(n * 10**17), "gas": "0x5208", "input": "0x",
    }


def _blocks(numbers):
    rng = random.Random(1)
    pool = [*WATCHED.values(), *(w.upper().replace("X", "x") for w in WATCHED.values()), "0x" + "e" * 40, None]
    return [{"number": hex(b), "transactions": [_tx(b, n, rng.choice(pool), rng.choice(pool)) for n in range(6)]} for b in numbers]


def _land(folder, blocks):
    folder.mkdir(exist_ok=True)
    for block in blocks:
        number = int(block["number"], 16)
        (folder / f"{number:05}.json").write_text(json.dumps(block))
        os.utime(folder / f"{number:05}.json", (1.7e9 + number,) * 2)  # Files are taken up in order of time.


def _registry(session, active=(1, 2, 3)):
    rows = [(i, f"P{i}", a, i in active, f"2024-01-0{i}") for i, a in WATCHED.items()]
    df = session.createDataFrame(rows, "id bigint, name string, address string, is_active boolean, at string")
    return df.withColumn("created_at", F.to_timestamp("at")).drop("at")


def _answers(requests):
    # The hash decides the score: even numbers are alerts.
    number = F.conv(F.substring("tx_hash", 7, 4), 16, 10).cast("int")
    text = F.format_string('{"risk_score": %d}', F.when(number % 2 == 0, 90).otherwise(10))
    return requests.select("tx_hash", text.alias("content"))


def _job(root, **options):
    return ingest.MonitorJob(str(root), _registry, provider=_answers, as_of="2024-01-01 00:00:00", **options)


def _run(spark, landed, job, tmp_path):
    stream = chain.stream_blocks(spark, str(landed))
    query = ingest.start_monitor(stream, job, str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination()
    return query


def _want(blocks):
    """First writer per hash: the newest protocol, here the one with the highest id."""
    out = {}
    for block in blocks:
        for tx in block["transactions"]:
            sides = {(tx["to"] or "").lower(), (tx["from"] or "").lower()}
            owners = [i for i, a in WATCHED.items() if a in sides]
            if owners:
                out[tx["hash"]] = max(owners)
    return out


def _stored(spark, root):
    return tables.read_table(spark, str(root), "transactions").collect()


def test_stream_equals_batch_and_survives_replays(spark, tmp_path):
    blocks = _blocks(range(100, 112))
    landed, root = tmp_path / "landed", tmp_path / "tables"
    _land(landed, blocks)
    _run(spark, landed, _job(root), tmp_path)
    rows, want = _stored(spark, root), _want(blocks)
    assert {r.tx_hash: r.protocol_id for r in rows} == want and len(rows) == len(want)
    assert len({r.id for r in rows}) == len(rows) and len({r.batch_id for r in rows}) == 3
    alerts = tables.read_table(spark, str(root), "alerts").collect()
    assert {r.transaction_id for r in alerts} == {r.id for r in rows if r.risk_score == 90}
    box = ingest.read_outbox(spark, str(root)).collect()
    assert {r.alert_id for r in box} == {r.id for r in alerts} and all("<code>90</code>" in r.message for r in box)
    runs = {r.batch_id: r for r in ingest.read_runs(spark, str(root)).collect()}
    assert [runs[n].blocks for n in (0, 1, 2)] == [5, 5, 2] and sum(r.transactions_found for r in runs.values()) == len(rows)
    assert sum(r.alerts_fired for r in runs.values()) == len(alerts) and runs[0].protocols_checked == 3
    assert {tuple(r) for r in ingest.read_cursors(spark, str(root)).collect()} == {(i, 111) for i in WATCHED}
    lines = eventlog.parse_events(ingest.read_event_lines(spark, str(root)), "line").groupBy("event").count()
    want_lines = {"transaction.fetched": len(rows), "transaction.scored": len(rows), "alert.created": len(alerts), "worker.poll.complete": 3}
    assert {r.event: r["count"] for r in lines.collect()} == want_lines

    # Nothing new: nothing happens. A block landed again under another name adds no row, no alert.
    _run(spark, landed, _job(root), tmp_path)
    (landed / "again.json").write_text(json.dumps(blocks[3]))
    _land(landed, _blocks(range(112, 114)))
    _run(spark, landed, _job(root), tmp_path)
    more = _stored(spark, root)
    later = {r.tx_hash for r in more} - {r.tx_hash for r in rows}
    assert len(more) == len({r.tx_hash for r in more}) and later == set(_want(_blocks(range(112, 114))))
    assert {r.id for r in rows} <= {r.id for r in more}


def test_repeated_batch_writes_the_same(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "tables"
    _land(landed, _blocks(range(20, 24)))
    blocks = chain.read_blocks(spark, str(landed))
    job = _job(root)
    job(blocks, 0)
    before = sorted(map(str, _stored(spark, root)))
    # The registry has changed since; the batch keeps what it was staged with.
    job.registry = lambda session: _registry(session, active=(1,))
    job(blocks, 0)
    assert sorted(map(str, _stored(spark, root))) == before
    alerts = tables.read_table(spark, str(root), "alerts")
    assert alerts.count() == alerts.select("transaction_id").distinct().count() > 0


def test_inactive_protocols_and_empty_batches(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "tables"
    _land(landed, _blocks(range(20, 22)))
    job = ingest.MonitorJob(str(root), lambda s: _registry(s, active=()), provider=_answers)
    _run(spark, landed, job, tmp_path)
    assert _stored(spark, root) == []
    (run,) = ingest.read_runs(spark, str(root)).collect()
    assert (run.blocks, run.transactions_found, run.alerts_fired, run.protocols_checked) == (2, 0, 0, 0)


def test_rules_receipts_and_whole_table_lookup(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "tables"
    _land(landed, [{"number": "0x5", "transactions": [_tx(5, 1, WATCHED[1]), _tx(5, 2, WATCHED[2])]}])
    seen = []

    def receipts(first, last):
        seen.append((first, last))
        return spark.createDataFrame([("0x00050001", "0x9999", "0x5")], schemas.RECEIPT)

    job = ingest.MonitorJob(str(root), _registry, receipts=receipts, threshold=0)
    _run(spark, landed, job, tmp_path)
    got = {r.tx_hash: r for r in _stored(spark, root)}
    assert seen == [(5, 5)] and got["0x00050001"].gas_used == 0x9999 and got["0x00050002"].gas_used == 21000
    assert all(0 <= r.risk_score <= 100 for r in got.values()) and tables.read_table(spark, str(root), "alerts").count() == 2


def test_receipts_of_the_blocks_between_are_not_asked_for(spark, tmp_path):
    numbers, seen, used = [5, 7, 900, 500_000, 500_001], [], set()

    def receipts(first, last):
        seen.append((first, last))
        inside = [n for n in numbers if first <= n <= last]
        return spark.createDataFrame([(f"0x{n:04x}0001", hex(n), hex(n)) for n in inside], schemas.RECEIPT)

    def answers(requests):
        used.add(requests.sparkSession.conf.get(ingest.PARTITIONS))
        return _answers(requests)

    _land(tmp_path / "landed", [{"number": hex(n), "transactions": [_tx(n, 1, WATCHED[1])]} for n in numbers])
    blocks, usual = chain.read_blocks(spark, str(tmp_path / "landed")), spark.conf.get(ingest.PARTITIONS)
    job = ingest.MonitorJob(str(tmp_path / "tables"), _registry, receipts=receipts, provider=answers)
    spark.conf.set(ingest.PARTITIONS, "500")
    try:
        job(blocks, 0)
        assert spark.conf.get(ingest.PARTITIONS) == "500"
    finally:
        spark.conf.set(ingest.PARTITIONS, usual)
    assert seen == [(5, 900), (500_000, 500_001)] and used == {str(2 * spark.sparkContext.defaultParallelism)}
    assert {r.block_number: r.gas_used for r in _stored(spark, tmp_path / "tables")} == {n: n for n in numbers}
    (run,) = ingest.read_runs(spark, str(tmp_path / "tables")).collect()
    assert (run.from_block, run.to_block, run.blocks) == (5, 500_001, 5)


def test_stretches_are_few():
    assert ingest.stretches([(1, 900), (1_000, 1_999), (3_500, 3_600)]) == [(1, 1_999), (3_500, 3_600)]
    many = ingest.stretches([(n * n * 10**4, n * n * 10**4 + 1) for n in range(500)])
    assert 1 < len(many) <= ingest.MOST_STRETCHES and (many[0][0], many[-1][1]) == (0, 499 * 499 * 10**4 + 1)


def test_same_hash_in_a_far_block_is_stored_once(spark, tmp_path):
    near, far = _tx(5, 1, WATCHED[1]), {**_tx(5, 1, WATCHED[1]), "blockNumber": hex(500_000)}
    root, job = tmp_path / "tables", _job(tmp_path / "tables")
    for batch, tx in enumerate((near, far)):
        rows = [(tx["blockNumber"], [tuple(tx[c] for c in schemas.RAW_TRANSACTION.fieldNames())])]
        job(spark.createDataFrame(rows, schemas.BLOCK), batch)
    assert [r.block_number for r in _stored(spark, root)] == [5]


def test_absurd_block_numbers_stop_nothing(spark, tmp_path):
    root, job = tmp_path / "tables", _job(tmp_path / "tables")
    txs = [_tx(5, 1, WATCHED[1]), {**_tx(5, 2, WATCHED[1]), "blockNumber": hex(2**63 - 1)}, {**_tx(5, 3, WATCHED[2]), "blockNumber": None}]
    rows = [("0x5", [tuple(tx[c] for c in schemas.RAW_TRANSACTION.fieldNames()) for tx in txs]), (hex(2**63 - 1), [])]
    job(spark.createDataFrame(rows, schemas.BLOCK), 0)
    assert len(_stored(spark, root)) == 3


def test_new_checkpoint_and_backfill_store_all_their_blocks(spark, tmp_path):
    root, parts = tmp_path / "tables", [_blocks(range(n, n + 4)) for n in (20, 30, 40)]
    old = spark.createDataFrame([(7, "0xold", 1)], "id bigint, tx_hash string, block_number bigint")
    for name in schemas.TRANSACTIONS.fieldNames():
        if name not in old.columns:
            old = old.withColumn(name, F.lit(None).cast(schemas.TRANSACTIONS[name].dataType))
    tables.write_batch(old.select(*schemas.TRANSACTIONS.fieldNames()), str(root), "transactions", 2**40)
    for n, blocks in enumerate(parts[:2]):
        _land(tmp_path / f"landed{n}", blocks)
        stream = chain.stream_blocks(spark, str(tmp_path / f"landed{n}"))
        ingest.start_monitor(stream, _job(root), str(tmp_path / f"checkpoint{n}"), once=True).awaitTermination()
    _land(tmp_path / "landed2", parts[2] + parts[0])
    for _ in range(2):
        ingest.backfill_blocks(chain.read_blocks(spark, str(tmp_path / "landed2")), _job(root), "late")
    rows = _stored(spark, root)
    assert sorted(r.tx_hash for r in rows) == sorted(["0xold", *_want(parts[0] + parts[1] + parts[2])])
    assert len({r.id for r in rows}) == len(rows)


def test_rule_scores_do_not_depend_on_the_cut(spark, tmp_path):
    landed, found = tmp_path / "landed", []
    _land(landed, _blocks(range(60, 72)))
    for files in (1, 5, 50):
        root = tmp_path / f"t{files}"
        flagged = lambda session: session.createDataFrame([("0x" + "E" * 40,)], "address string")
        job = ingest.MonitorJob(str(root), _registry, as_of="2024-01-01 09:00:00", flagged=flagged)
        stream = chain.stream_blocks(spark, str(landed), files)
        ingest.start_monitor(stream, job, str(tmp_path / f"cp{files}"), once=True).awaitTermination()
        found.append({r.tx_hash: (r.risk_score, r.risk_summary) for r in _stored(spark, root)})
    assert found[0] == found[1] == found[2] and len({s for s, _ in found[0].values()}) > 2


def test_answers_of_a_batch_are_kept(spark, tmp_path):
    _land(tmp_path / "landed", _blocks(range(20, 22)))
    blocks, job = chain.read_blocks(spark, str(tmp_path / "landed")), _job(tmp_path / "tables")
    job(blocks, 0)
    before = {r.tx_hash: r.risk_score for r in _stored(spark, tmp_path / "tables")}
    job.provider = lambda wanted: wanted.select("tx_hash", F.lit('{"risk_score": 1}').alias("content"))
    job(blocks, 0)
    assert {r.tx_hash: r.risk_score for r in _stored(spark, tmp_path / "tables")} == before


def test_limiter_stream_equals_audit(spark, tmp_path):
    rng = random.Random(9)
    base = int(datetime(2024, 1, 1).timestamp()) * 10**6
    rows = sorted((base + rng.randrange(300) * 10**6, rng.choice([1, 1, 2])) for _ in range(300))
    calls = spark.createDataFrame([(n, key, us) for n, (us, key) in enumerate(rows)], "id bigint, api_key_id bigint, us bigint")
    calls = calls.withColumn("created_at", F.timestamp_micros("us")).drop("us")
    rule = limiter.Limits(2, 12, 5, 60)
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    for part in range(3):
        calls.filter(F.floor(F.col("id") / 100) == part).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(calls.schema).parquet(landed)
        decided = limits.limit_stream(stream, rule)
        writer = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
    columns = ["api_key_id", "id", "allowed", "remaining", "reset_at", "retry_after", "created_at"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    assert got == sorted(map(tuple, limiter.audit(calls, rule).select(*columns).collect())) and len(got) == 300


def _decide_in_runs(spark, root, runs, rule, lateness):
    """Rows ``(id, key, second)`` of each run decided by a run of one stream; decisions by id, keys stored after each."""
    landed, out, stored = str(root / "landed"), str(root / "out"), []
    base = int(datetime(2024, 1, 1).timestamp())
    for rows in runs:
        calls = spark.createDataFrame([(i, k, base + s) for i, k, s in rows], "id bigint, api_key_id bigint, s bigint")
        calls = calls.select("id", "api_key_id", F.timestamp_seconds("s").alias("created_at"))
        calls.write.mode("append").parquet(landed)
        decided = limits.limit_stream(spark.readStream.schema(calls.schema).parquet(landed), rule, lateness=lateness)
        writer = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(root / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
        known = spark.read.format("statestore").option("path", str(root / "cp")).option("stateVarName", "known").load()
        stored.append({r.key.api_key_id for r in known.select("key").collect()})
    return {r.id: r for r in spark.read.schema(decided.schema).parquet(out).collect()}, stored


def test_limiter_stream_forgets_idle_keys(spark, tmp_path):
    runs = [
        [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 2, 3)],
        [(5, 2, 100), (6, None, 100)],
        [(7, 2, 103), (8, 1, 104)],
    ]
    got, stored = _decide_in_runs(spark, tmp_path, runs, limiter.Limits(2, 12, 5, 60), "10 seconds")
    assert stored == [{1, 2}, {2}, {1, 2}]
    assert {i: r.allowed for i, r in got.items()} == {1: True, 2: True, 3: False, 4: True, 5: True, 7: True, 8: True}
    assert got[7].remaining == 0 and got[8].remaining == 1 and not any(r.late for r in got.values())


def test_limiter_stream_flags_late_calls(spark, tmp_path):
    # Call 3 comes after call 2 was decided and counts as made then: the two of the last 5 seconds are 2 and 3.
    runs = [[(1, 1, 0), (2, 1, 20)], [(3, 1, 10), (4, 1, 21)], [(5, 1, 20), (6, 1, 25)]]
    got, _ = _decide_in_runs(spark, tmp_path, runs, limiter.Limits(2, 12, 5, 60), "1 hour")
    assert {i: (r.allowed, r.late) for i, r in got.items()} == {
        1: (True, False), 2: (True, False), 3: (True, True), 4: (False, False), 5: (False, True), 6: (True, False),
    }
    assert got[3].created_at.second == 10


def test_limiter_stream_keeps_as_many_times_as_decisions_need(spark, tmp_path):
    # The stored list is rewritten on the way: 12 admitted calls in 6 micro-batches, two times are needed.
    runs = [[(2 * n, 1, 10 * n), (2 * n + 1, 1, 10 * n + 1), (100 + n, 1, 10 * n + 2)] for n in range(6)]
    got, _ = _decide_in_runs(spark, tmp_path, runs, limiter.Limits(2, 2, 5, 8), "1 hour")
    assert {i: r.allowed for i, r in got.items()} == {i: i < 100 for rows in runs for i, _, _ in rows}


def test_unreadable_fields_are_kept_and_flagged(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "tables"
    odd = [{**_tx(900_000, 2, WATCHED[1]), "value": "0xnone"}, {**_tx(900_000, 4, WATCHED[1]), "blockNumber": "?"}]
    _land(landed, [{"number": hex(900_000), "transactions": [*odd, _tx(900_000, 6, WATCHED[2])]}])
    _run(spark, landed, _job(root), tmp_path)
    got = {r.tx_hash[-1]: r for r in _stored(spark, root)}
    assert got["2"].value_eth is None and got["4"].block_number is None and got["6"].value_eth is not None
    # All three are alerts here, also the one without a block.
    assert tables.read_table(spark, str(root), "alerts").count() == 3 == ingest.read_outbox(spark, str(root)).count()
    staged = spark.read.parquet(f"{root}/staged")
    assert {r.tx_hash[-1]: r.quarantined for r in staged.collect()} == {"2": True, "4": True, "6": False}
