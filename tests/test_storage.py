"""Stored tables, landed files, event log."""

import json

from pyspark.sql import functions as F

from hexwarden import schemas
from hexwarden.plans import feeds, stats
from hexwarden.sources import chain, eventlog, tables


def _transactions(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, tx_hash string, block_number bigint")
    for field in schemas.TRANSACTIONS.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*schemas.TRANSACTIONS.fieldNames())


def test_missing_table_reads_empty(spark, tmp_path):
    df = tables.read_table(spark, str(tmp_path), "transactions")
    assert df.count() == 0 and {"block_group", "batch_id", "tx_hash"} <= set(df.columns)


def test_batches_replace_themselves(spark, tmp_path):
    root, step = str(tmp_path), tables.BLOCKS_PER_GROUP
    tables.write_batch(_transactions(spark, [(1, "a", 1), (2, "b", step)]), root, "transactions", 0)
    tables.write_batch(_transactions(spark, [(3, "c", step + 1)]), root, "transactions", 1)
    tables.write_batch(_transactions(spark, [(1, "a", 1), (2, "b", step)]), root, "transactions", 0)
    table = tables.read_table(spark, root, "transactions")
    assert sorted((r.id, r.block_group, r.batch_id) for r in table.collect()) == [(1, 0, 0), (2, 1, 0), (3, 1, 1)]
    assert sorted(r.id for r in tables.read_table(spark, root, "transactions", but_batch=1).collect()) == [1, 2]
    assert [r.id for r in tables.read_table(spark, root, "transactions", batch_id=1).collect()] == [3]
    # Fewer partitions, and none at all.
    tables.write_batch(_transactions(spark, [(1, "a", 1)]), root, "transactions", 0)
    assert sorted(r.id for r in tables.read_table(spark, root, "transactions").collect()) == [1, 3]
    tables.write_batch(_transactions(spark, [(1, "a", 1)]).limit(0), root, "transactions", 0)
    assert sorted(r.id for r in tables.read_table(spark, root, "transactions").collect()) == [3]


def test_runs_are_allotted_once(spark, tmp_path):
    runs = [tables.allotted_run(spark, str(tmp_path), owner) for owner in ("a", "b", "a", "c", "b")]
    assert runs == [1, 2, 1, 3, 2]


def test_replacing_partitions_computed_from_the_table(spark, tmp_path):
    root = str(tmp_path)
    rows = [(n, f"h{n}", n * tables.BLOCKS_PER_GROUP) for n in range(4)]
    tables.write_batch(_transactions(spark, rows), root, "transactions", 0)
    scores = spark.createDataFrame([("h1", 88, "new"), ("h3", 7, "new"), ("?", 1, "")], "tx_hash string, risk_score int, risk_summary string")
    assert [r.tx_hash for r in tables.store_scores(spark, root, scores, "2024-01-01 00:00:00").collect()] == ["?"]
    got = {r.id: r.risk_score for r in tables.read_table(spark, root, "transactions").collect()}
    assert got == {0: None, 1: 88, 2: None, 3: 7}


def test_snapshot_goes_to_a_new_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "0xAb")], "id bigint, address string")
    path = tables.write_snapshot(df, str(tmp_path), "protocols-2")
    assert spark.read.parquet(path).count() == 1
    try:
        tables.write_snapshot(df, str(tmp_path), "protocols-2")
    except Exception as exc:
        assert "PATH_ALREADY_EXISTS" in str(exc)
    else:
        raise AssertionError("a snapshot in use was overwritten")


def test_request_log_is_cut_by_day(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id bigint, at string")
    df = df.selectExpr("id", "1L AS api_key_id", "'/api/x' AS endpoint", "'GET' AS method", "200 AS status_code", "5 AS response_ms", "timestamp(at) AS created_at")
    tables.write_batch(df, str(tmp_path), "request_log", 0)
    assert sorted(p.name for p in (tmp_path / "request_log").glob("batch_id=0/day=*")) == ["day=2024-01-01", "day=2024-01-02"]
    assert tables.read_table(spark, str(tmp_path), "request_log").filter("day = date'2024-01-02'").first().id == 2


def test_reports_open_only_their_days(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "id % 3 AS api_key_id", "'/api/x' AS endpoint", "'GET' AS method", "200 AS status_code", "5 AS response_ms", "timestamp('2024-01-01') + make_interval(0, 0, 0, cast(id AS int)) AS created_at")
    tables.write_batch(df, str(tmp_path), "request_log", 0)
    log = tables.read_table(spark, str(tmp_path), "request_log")
    for report, want in (
        (stats.requests_on_day(log, "2024-01-05 10:00:00"), [(1,)]),
        (stats.daily_requests(spark, log, "2024-01-05 10:00:00", 2), [("2024-01-04", 1), ("2024-01-05", 1)]),
    ):
        text = report._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in text
        assert [tuple(r) for r in report.collect()] == want


def test_landed_blocks(spark, tmp_path):
    tx = {"hash": "0x1", "blockNumber": "0xa", "from": "0xf", "to": None, "value": "0x0", "gas": "0x1", "input": "0x", "extra": 1}
    blocks = [{"number": "0xa", "transactions": [tx, {**tx, "hash": "0x2"}]}, {"number": "0x9", "transactions": []}, {"number": "0x10"}]
    (tmp_path / "b.json").write_text("\n".join(json.dumps(b) for b in blocks))
    df = chain.read_blocks(spark, str(tmp_path))
    assert sorted(r.hash for r in chain.block_transactions(df).collect()) == ["0x1", "0x2"]
    assert chain.head_block(df).first().head == 16
    assert chain.head_block(df.limit(0)).first().head is None


def test_event_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1), ("2024-01-01 00:00:00.05", None, 2)], "at string, who string, n int")
    line = eventlog.event_line(F.to_timestamp("at"), F.lit("INFO"), F.lit("worker.start"), {"who": F.col("who"), "n": F.col("n")})
    lines = sorted((r.line for r in df.select(line.alias("line")).collect()), key=len)
    assert json.loads(lines[0])["ts"] == "2024-01-01T00:00:00Z"
    assert json.loads(lines[1]) == {"ts": "2024-01-01T00:00:00.050000Z", "level": "INFO", "service": "hexwarden", "event": "worker.start", "who": None, "n": 2}
    eventlog.write_events(df.select(line.alias("line")), str(tmp_path / "log"))
    (tmp_path / "log" / "extra.txt").write_text('{"ts": "2024-01-02T00:00:00Z", "event": "x", "deep": {"k": [7]}}\nnot json\n')
    events = eventlog.read_events(spark, str(tmp_path / "log"))
    assert events.count() == 4
    assert events.filter("event = 'x'").select(eventlog.event_field("deep.k[0]", "int").alias("k")).first().k == 7
    assert events.filter("fields IS NULL").first().raw == "not json"
    assert events.filter(eventlog.event_field("n", "int") == 2).first().ts.microsecond == 50000


def test_lookup_columns_have_bloom_filters(spark, tmp_path):
    rows = [(n, f"0x{n:064x}", n) for n in range(2000)]
    tables.write_batch(_transactions(spark, rows), str(tmp_path), "transactions", 0)
    (sample, *_) = (tmp_path / "transactions").rglob("*.parquet")
    found = tables.read_table(spark, str(tmp_path), "transactions").filter(F.col("tx_hash") == rows[7][1])
    assert [r.id for r in found.collect()] == [7]
    assert "EqualTo(tx_hash" in found._jdf.queryExecution().executedPlan().toString()
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
            spark._jvm.org.apache.hadoop.fs.Path(str(sample)), spark._jsc.hadoopConfiguration()
        )
    )
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    with_filter = {c.getPath().toDotString() for c in columns if c.getBloomFilterOffset() > 0}
    reader.close()
    assert with_filter == {"tx_hash"}


def test_poll_events(spark):
    from hexwarden.operators.events import poll_events

    runs = spark.createDataFrame([(0, 1, 5, 5, 3, 7, 2, 40)], schemas.RUNS)
    (row,) = poll_events(runs, F.lit("2024-01-01").cast("timestamp")).collect()
    assert json.loads(row.line)["transactions_found"] == 7


def test_receipts_of_a_block_range(spark, tmp_path):
    step = tables.BLOCKS_PER_GROUP
    for group, number in ((0, 7), (0, 9), (2, 2 * step)):
        folder = tmp_path / f"block_group={group}"
        folder.mkdir(exist_ok=True)
        receipt = {"transactionHash": f"h{number}", "gasUsed": "0x1", "blockNumber": hex(number)}
        (folder / f"{number}.json").write_text(json.dumps(receipt))
    receipts = chain.read_receipts(spark, str(tmp_path))
    assert "block_group" in receipts.columns
    got = chain.receipts_between(receipts, 8, 9)
    assert [r.transactionHash for r in got.collect()] == ["h9"]
    assert "PartitionFilters: [isnotnull(block_group" in got._jdf.queryExecution().executedPlan().toString()
    assert chain.receipts_between(receipts.drop("block_group"), 7, 2 * step).count() == 3


def test_lookups_without_case_reach_the_files(spark, tmp_path):
    df = spark.createDataFrame([(n, f"0xAB{n}") for n in range(50)], "id bigint, address string")
    tables.write_batch(df, str(tmp_path), "protocols", 0)
    found = feeds.protocol_by_address(tables.read_table(spark, str(tmp_path), "protocols"), "0xaB7")
    assert [r.id for r in found.collect()] == [7]
    assert "EqualTo(address_lc,0xab7)" in found._jdf.queryExecution().executedPlan().toString()
