"""The monitoring loop: landed blocks in; transactions, alerts, messages, events and run records out.

One micro-batch is: match, decode, first writer, skip what is stored, score, alert, outbox, run record.
Its matched rows are first written to ``staged/batch_id=<n>``, and a provider's answers to
``answers/batch_id=<n>``. A repeated batch reads both again, even if the registry or the provider has changed
since, so it writes the same rows to the same folders; and what follows starts from a small written table
instead of a growing lineage.

Batch numbers and ids belong to a run. Every checkpoint - and every backfill - is allotted a run once
(``tables.allotted_run``); its batches and ids lie in a range of their own, above those of tables that were
filled by other means. So a new checkpoint on the same tables stages anew, and a backfill can go on beside a
running stream.

Whether a hash is stored, and from which block on a sender is no rare one, is asked of lookup tables
(``sources.lookup``), so a batch reads neither the stored transactions nor their keys as a whole. The keys of a batch
are kept there before its rows are stored: a batch that stops in between has to be repeated, which the stream does by
itself and ``backfill_blocks`` under the same name.

A batch is small beside what a step costs by itself. So shuffles have as many partitions as the batch needs, not as
many as the session has for whole tables, and steps that do not need each other run at the same time.
"""

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from hexwarden import schemas
from hexwarden.functions.clock import AsOf, as_of_column
from hexwarden.functions.hexnum import hex_to_long
from hexwarden.functions.risk import ALERT_THRESHOLD
from hexwarden.operators import alerts as alert_ops, events, ingest, matching
from hexwarden.operators.ids import with_dense_ids
from hexwarden.operators.rules import RuleWeights, rule_scores
from hexwarden.operators.scoring import ScoreProvider, apply_scores, resolve_scores, scoring_requests
from hexwarden.session import shuffle_settings
from hexwarden.sources import chain, tables
from hexwarden.sources.lookup import MERGE_AFTER, Lookup, smallest

POLL_SECONDS, POLL_SECONDS_MIN = 15, 10  # Fixed values.
# An id is made of run, batch of the run and place in the batch; run 0 is left to rows that were there before.
RUN_BITS, BATCH_BITS, ROW_BITS = 8, 25, 30

OUTBOX = "outbox"
RUNS, CURSORS, EVENTS = "runs", "cursors", "events"
STAGED, NUMBERED, ANSWERS = "staged", "numbered", "answers"
# Blocks kept for each sender; a sender with more transactions than the rules call rare needs no more.
SENDER_BLOCKS = 8
PARTITIONS = "spark.sql.shuffle.partitions"
# Bytes a batch may shuffle for each byte landed: landed files are packed, and rows go twice where two protocols match.
SHUFFLED_PER_LANDED = 32
# Receipts are asked for by stretches of the batch's blocks: files are taken up by the time they landed, so a batch may
# hold blocks from both ends of the chain. Blocks no further apart than this are one stretch, and there are no more of them.
STRETCH_BLOCKS, MOST_STRETCHES = 1_000, 64


def _observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and their number once they have been written: no action of its own."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


def _number(seen: Observation) -> int:
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0  # Spark found out beforehand that there are no rows, and dropped the count with them.


def stretches(ends: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Block ranges, given in order, with those put together that lie near each other."""
    gaps = sorted((later[0] - earlier[1] for earlier, later in zip(ends, ends[1:])), reverse=True)
    near = max(STRETCH_BLOCKS, gaps[MOST_STRETCHES - 1]) if len(gaps) >= MOST_STRETCHES else STRETCH_BLOCKS
    out: list[tuple[int, int]] = []
    for first, last in ends:
        if out and first - out[-1][1] <= near:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def _landed(blocks: DataFrame) -> tuple[list[tuple[int, int]], int]:
    """Lowest and highest number of the blocks in each ``STRETCH_BLOCKS`` that has some, in order; and how many blocks
    there are, those without a readable number too."""
    number = hex_to_long(F.col("number"))
    of = blocks.select(number.alias("n")).groupBy(F.floor(F.col("n") / F.lit(STRETCH_BLOCKS)).alias("part"))
    found = of.agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("blocks")).collect()
    ends = sorted((row["first"], row["last"]) for row in found if row["first"] is not None)
    return ends, sum(row["blocks"] for row in found)


@contextmanager
def _fitted(blocks: DataFrame) -> Iterator[None]:
    """Shuffles of the session get no more partitions than the batch needs, by the length of its files; where that is
    not known Spark names a size beyond all files, and the session's number stays."""
    conf, context = blocks.sparkSession.conf, blocks.sparkSession.sparkContext
    size = int(blocks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    usual = conf.get(PARTITIONS)
    wanted = shuffle_settings(size * SHUFFLED_PER_LANDED, context.defaultParallelism)[PARTITIONS]
    conf.set(PARTITIONS, str(min(int(usual), int(wanted))))
    try:
        yield
    finally:
        conf.set(PARTITIONS, usual)


def _together(spark: SparkSession, step: Callable[[], object], *others: Callable[[], object]) -> list:
    """Run steps that do not need each other at the same time, the first in the caller's thread; returns what each gives.
    All have ended when an error of one is raised."""
    with ThreadPoolExecutor(max(len(others), 1)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(other)) for other in others]
        own = step()
    return [own, *(one.result() for one in waiting)]


@dataclass
class MonitorJob:
    """Settings of the monitoring loop.

    ``registry`` is called once for every batch, so changes to it take effect at the next one. ``receipts``
    gets the first and last block of each stretch of the batch's blocks and returns their receipts. ``provider`` scores; without
    one the built-in rules do, with ``weights`` and ``flagged`` senders (column ``address``), and senders
    counted over all stored transactions up to the own block. ``run`` is the number that was allotted;
    lookups are merged when ``merge_after`` batches have gathered.
    """

    root: str
    registry: Callable[[SparkSession], DataFrame]
    receipts: Callable[[int, int], DataFrame] | None = None
    provider: ScoreProvider | None = None
    threshold: int = ALERT_THRESHOLD
    as_of: AsOf = None
    weights: RuleWeights = field(default_factory=RuleWeights)
    flagged: Callable[[SparkSession], DataFrame] | None = None
    run: int = 1
    merge_after: int = MERGE_AFTER

    def number(self, batch_id: int) -> int:
        """The batch among those of all runs."""
        if not (0 < self.run < 2**RUN_BITS and 0 <= batch_id < 2**BATCH_BITS):
            raise ValueError(f"no ids are left for batch {batch_id} of run {self.run}")
        return ((self.run - 1) << BATCH_BITS) + batch_id

    def first_id(self, batch: int) -> int:
        return (batch + (1 << BATCH_BITS)) << ROW_BITS

    def _kept(self, spark: SparkSession, name: str, batch: int, schema, build: Callable[[], DataFrame]) -> DataFrame:
        """What an earlier attempt of the batch has written whole, or else what ``build`` gives, written."""
        path = f"{tables.table_path(self.root, name)}/batch_id={batch}"
        if not tables.path_exists(spark, f"{path}/_SUCCESS"):
            build().select(*schema.fieldNames()).write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)

    def _matches(self, blocks: DataFrame, active: DataFrame, ends: list[tuple[int, int]]) -> DataFrame:
        """Decoded matches of the batch, one row per transaction."""
        matched = matching.match(chain.block_transactions(blocks), active)
        rows = ingest.first_writer(matched, "hash", hex_to_long(F.col("blockNumber")))
        if self.receipts is not None:
            parts = [self.receipts(*stretch).select("transactionHash", "gasUsed") for stretch in stretches(ends)]
            rows = matching.with_receipts(rows, reduce(DataFrame.unionByName, parts))
        return matching.decode(rows)

    def __call__(self, blocks: DataFrame, batch_id: int) -> None:
        """Process one micro-batch."""
        with _fitted(blocks):
            self._process(blocks, self.number(batch_id))

    def _process(self, blocks: DataFrame, batch: int) -> None:
        started = time.monotonic()
        spark = blocks.sparkSession
        ends, count = _landed(blocks)
        landed = (ends[0][0], ends[-1][1], count) if ends else (None, None, count)
        registry = self.registry(spark)
        active = registry.filter("is_active")
        found, fired, checked, lines = 0, 0, 0, None
        if ends:
            cursors = active.select(F.col("id").alias("protocol_id"), F.lit(landed[1]).alias("last_seen_block"))
            cursors, polled_protocols = _observed(cursors)
            keys, senders = self._lookups()
            staged, *_ = _together(
                spark,
                lambda: self._kept(spark, STAGED, batch, schemas.STAGED, lambda: self._matches(blocks, active, ends)),
                lambda: tables.write_batch(cursors, self.root, CURSORS, batch),
                lambda: keys.open(spark),
                lambda: senders.open(spark),
            )
            checked = _number(polled_protocols)
            if not staged.isEmpty():
                found, fired, lines = self._store(spark, staged, registry, keys, senders, batch)
        duration = int((time.monotonic() - started) * 1000)
        run = spark.createDataFrame([(batch, *landed, checked, found, fired, duration)], schemas.RUNS)
        polled = events.poll_events(run, as_of_column(self.as_of))
        _together(
            spark,
            lambda: tables.write_batch(polled if lines is None else lines.unionByName(polled), self.root, EVENTS, batch),
            lambda: tables.write_batch(run, self.root, RUNS, batch),
        )

    def _store(
        self, spark: SparkSession, staged: DataFrame, registry: DataFrame, keys: Lookup, senders: Lookup, batch: int
    ) -> tuple:
        """Write the new transactions, their alerts and messages; returns how many of the first two, and their events."""
        _together(spark, lambda: self._caught_up(spark, keys, batch), lambda: self._caught_up(spark, senders, batch))
        known = keys.among(staged.select("tx_hash"), batch, self.run)
        fresh = ingest.absent_from(staged, known, "tx_hash")
        base = F.lit(self.first_id(batch)).cast("bigint")
        rows = self._new_rows(ingest.transaction_rows(fresh, self.as_of), base, batch)
        keep = [lambda: keys.write(rows, self.run, batch), lambda: senders.write(rows, self.run, batch)]
        if self.provider is None:
            _together(spark, *keep)
            scores = self._rules(spark, rows, senders, batch)
        else:
            asked = scoring_requests(rows, registry)
            answers, *_ = _together(
                spark,
                lambda: self._kept(spark, ANSWERS, batch, schemas.ANSWERS, lambda: _with_attempt(self.provider(asked))), *keep
            )
            scores = resolve_scores(rows, answers)
        scored, stored_rows = _observed(apply_scores(rows, scores, self.as_of))
        tables.write_batch(scored.select(*schemas.TRANSACTIONS.fieldNames()), self.root, "transactions", batch)

        stored = tables.read_table(spark, self.root, "transactions", batch_id=batch)
        raised, alert_rows = _observed(alert_ops.new_alerts(stored, base, self.threshold, self.as_of))
        tables.write_batch(raised.select(*schemas.ALERTS.fieldNames()), self.root, "alerts", batch)
        alerts = tables.read_table(spark, self.root, "alerts", batch_id=batch)
        tables.write_batch(alert_ops.outbox(alerts, stored, registry), self.root, OUTBOX, batch)
        return _number(stored_rows), _number(alert_rows), events.monitor_events(stored, alerts, registry)

    def _lookups(self) -> tuple[Lookup, Lookup]:
        """The stored hashes, and the first blocks of each sender."""
        of = schemas.TRANSACTIONS
        keys = Lookup(self.root, "tx_hash", "tx_hash", T.StructType([of["tx_hash"]]), lambda rows: rows.distinct())
        kept = smallest("from_address", "block_number", SENDER_BLOCKS)
        senders = Lookup(self.root, "senders", "from_address", T.StructType([of["from_address"], of["block_number"]]), kept)
        return keys, senders

    def _caught_up(self, spark: SparkSession, lookup: Lookup, batch: int) -> None:
        """Take in what has to be before ``batch`` asks; batches of this run below it are through."""
        lookup.adopt(spark, "transactions", batch)
        lookup.merge(spark, self.run, batch, self.merge_after)

    def _rules(self, spark: SparkSession, rows: DataFrame, senders: Lookup, batch: int) -> DataFrame:
        """Scores by the rules; the batch's senders are looked up, history is not read."""
        if self.weights.rare_sender_upto >= SENDER_BLOCKS:
            raise ValueError(f"senders are rare up to {SENDER_BLOCKS - 1} transactions at most")
        known = senders.among(rows.select("from_address"), batch, self.run)
        history = known.unionByName(rows.select("from_address", "block_number"))
        flagged = None if self.flagged is None else self.flagged(spark)
        return rule_scores(rows, flagged, self.weights, history, by_block=True)

    def _new_rows(self, fresh: DataFrame, base, batch: int) -> DataFrame:
        """Number the rows and write them: scoring asks for them several times."""
        spark, path = fresh.sparkSession, f"{tables.table_path(self.root, NUMBERED)}/batch_id={batch}"
        fresh.write.mode("overwrite").parquet(f"{path}/fresh")
        rows = with_dense_ids(spark.read.schema(fresh.schema).parquet(f"{path}/fresh"), "tx_hash", base)
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def _with_attempt(answers: DataFrame) -> DataFrame:
    return answers if "attempt" in answers.columns else answers.withColumn("attempt", F.lit(1))


def start_monitor(
    blocks: DataFrame, job: MonitorJob, checkpoint: str, once: bool = False, poll_seconds: int = POLL_SECONDS
) -> StreamingQuery:
    """Run the loop over a stream of blocks; the checkpoint is the cursor and owns the job's run. ``once``
    takes what has landed and stops."""
    job.run = tables.allotted_run(blocks.sparkSession, job.root, checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{max(poll_seconds, POLL_SECONDS_MIN)} seconds"}
    return blocks.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def backfill_blocks(blocks: DataFrame, job: MonitorJob, name: str) -> None:
    """Take landed blocks as one batch of a run of its own, through the same path as the stream; safe beside a
    running stream, and the same again under the same ``name``."""
    job.run = tables.allotted_run(blocks.sparkSession, job.root, f"backfill:{name}")
    job(blocks, 0)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_table(spark, root, RUNS, schemas.RUNS)


def read_cursors(spark: SparkSession, root: str) -> DataFrame:
    """The last block seen for each protocol; ``polling.with_cursors`` puts it into the registry."""
    cursors = tables.read_table(spark, root, CURSORS, schemas.CURSORS)
    return cursors.groupBy("protocol_id").agg(F.max("last_seen_block").alias("last_seen_block"))


def read_event_lines(spark: SparkSession, root: str) -> DataFrame:
    """Log lines of all batches, for ``eventlog.parse_events(lines, "line")``."""
    return tables.read_table(spark, root, EVENTS, schemas.EVENT_LINES)


def read_outbox(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_table(spark, root, OUTBOX, schemas.OUTBOX)
