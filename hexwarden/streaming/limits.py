"""The rate limiter over a stream of calls: same decisions as the audit, state kept per key."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hexwarden.operators.limiter import AdmittedLog, Limits
from hexwarden.session import SETTINGS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
MICROS_PER_MILLI = 1_000


class LimiterProcessor(StatefulProcessor):
    """Keeps the newest admitted times of each key until its longest window is over.

    A micro-batch appends the times it admits; the list is rewritten when it is twice as long as decisions need.
    A timer removes a key once the watermark has passed the end of the window of its newest call.
    """

    def __init__(self, limits: Limits, key: str, ident: str) -> None:
        self.limits, self.key, self.ident = limits, key, ident
        self.needed = max(limits.per_minute, limits.per_day, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "at bigint")
        self.known = handle.getValueState("known", "newest bigint, stored bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The calls of one key in one micro-batch, which the trigger bounds, as two plain arrays.
        parts = [(pdf["at"].to_numpy(dtype=np.int64), pdf[self.ident].to_numpy()) for pdf in rows]
        at, idents = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((idents, at))
        at, idents = at[order], idents[order]
        newest, stored, timer = self.known.get() if self.known.exists() else (None, 0, None)
        late = np.zeros(len(at), dtype=bool) if newest is None else at < newest
        moments = at if newest is None else np.maximum(at, newest)

        log = AdmittedLog(self.limits, [one[0] for one in self.admitted.get()] if stored else ())
        allowed, remaining, reset, wait = log.decide(moments)
        added = [(one,) for one in moments[allowed].tolist()]
        if stored + len(added) > 2 * self.needed:
            self.admitted.put([(one,) for one in log.times.tolist()])
            stored = len(log.times)
        elif added:
            self.admitted.appendList(added)
            stored += len(added)
        newest = int(moments[-1])
        expires = -(-(newest + self.limits.longest_span) // MICROS_PER_MILLI)
        if timer != expires:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expires)
        self.known.update((newest, stored, expires))
        yield pd.DataFrame(
            {
                self.key: np.full(len(at), key[0]),
                self.ident: idents,
                "at": at,
                "allowed": allowed,
                "remaining": remaining,
                "reset_at": reset,
                "retry_after": wait,
                "late": late,
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.admitted.clear()
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def limit_stream(
    calls: DataFrame,
    limits: Limits = Limits(),
    key: str = "api_key_id",
    ident: str = "id",
    time: str = "created_at",
    lateness: str = "1 day",
) -> DataFrame:
    """Decisions on a stream of calls, in order of time and id within a micro-batch; adds the flag ``late``.

    A call older than one that an earlier micro-batch decided comes too late for its place: it is flagged and decided as
    of that newest call, as a limiter does that learns of the call only now. A call older than the newest of all keys
    by ``lateness`` is behind the watermark: Spark leaves it out and counts it in the progress of the query
    (``numRowsDroppedByWatermark``). A key is forgotten once the watermark is past its longest window, which
    changes no decision.

    This kind of state needs the RocksDB store, which the session chooses (``session.build_session`` does).
    """
    if calls.sparkSession.conf.get(STATE_STORE) != SETTINGS[STATE_STORE]:
        raise ValueError(f"the session needs {STATE_STORE} = {SETTINGS[STATE_STORE]}")
    types = {c: calls.schema[c].dataType.simpleString() for c in (key, ident)}
    schema = (
        f"{key} {types[key]}, {ident} {types[ident]}, at bigint, allowed boolean, "
        "remaining int, reset_at bigint, retry_after int, late boolean"
    )
    rows = calls.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, lateness)
    decided = (
        rows.select(key, ident, time, F.unix_micros(time).alias("at"))
        .groupBy(key)
        .transformWithStateInPandas(
            LimiterProcessor(limits, key, ident), outputStructType=schema, outputMode="append", timeMode="eventTime"
        )
    )
    return decided.withColumn(time, F.timestamp_micros("at")).drop("at")
