"""Audit of the sliding-log rate limiter over a request log.

A call is admitted if fewer calls than the limit were admitted in the last minute and in the last day;
refused calls do not count. So each decision depends on earlier ones. The audit keeps that work small:

1. The offered load counts refused calls too, so a call whose load passes no limit is admitted for certain.
   ``offered_load`` spreads even the busiest key over many tasks.
2. A call that passes a limit in offered load is contested. It depends on the calls of its day, or, where only the
   minute is in question, of its minute. ``stretches`` cuts each key wherever no contested call depends on
   an earlier one: there the admitted calls are known, since they are the offered ones.
3. Each stretch is replayed by itself, in order, seeded with the certain calls it depends on, as a stream of Arrow
   batches. It holds as many admitted times as the larger limit, whatever its length.
4. All other calls are settled by their loads.

A key that is over its day limit without a pause of a day is one stretch: no decision in it is known before the
earlier ones are. It is one sorted stream for one task, which spills but is not gathered in memory.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hexwarden.operators.load import MICROS, offered_load
from hexwarden.workspace import written

# Default limits per key.
PER_MINUTE = 60
PER_DAY = 5000
# Stretches are found from one row per key and slot; a long window has this many slots.
SLOTS_PER_WINDOW = 256


@dataclass(frozen=True)
class Limits:
    per_minute: int = PER_MINUTE
    per_day: int = PER_DAY
    minute_seconds: int = 60
    day_seconds: int = 86_400

    @property
    def minute_span(self) -> int:
        return self.minute_seconds * MICROS

    @property
    def day_span(self) -> int:
        return self.day_seconds * MICROS

    @property
    def longest_span(self) -> int:
        return max(self.minute_span, self.day_span)


DECISION_COLUMNS = ("allowed", "remaining", "reset_at", "retry_after")
_NEVER, _ALWAYS = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class AdmittedLog:
    """The newest admitted times of one key, and the decisions that follow from them.

    With a limit of m there is room for a call once the m-th newest admitted time has left the window. The log in front of
    a call thus tells the moment from which each of the next min(limits) calls has room, so runs of
    admitted calls, and of refused ones, are decided at once.
    """

    def __init__(self, limits: Limits, admitted: Sequence[int] | np.ndarray = ()) -> None:
        self.limits = limits
        self.times = np.empty(0, dtype=np.int64)
        self.admit(np.asarray(admitted, dtype=np.int64))

    def admit(self, at: np.ndarray) -> None:
        """Append times known to be admitted, none of them before the last one."""
        self.times = np.concatenate([self.times, at])[-max(self.limits.per_minute, self.limits.per_day, 1) :]

    def _room_from(self, log: np.ndarray, size: int, count: int, limit: int, span: int) -> np.ndarray:
        """Moments from which calls number ``size`` to ``size + count - 1`` of the log have room in one window."""
        if limit <= 0:
            return np.full(count, _NEVER)
        places = np.arange(size - limit, size - limit + count)
        return np.where(places >= 0, log[np.maximum(places, 0)] + span, _ALWAYS)

    def decide(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Decide calls at the sorted times ``at``: allowed, remaining, reset second, seconds to wait."""
        limits, n = self.limits, len(at)
        block = max(1, min(limits.per_minute, limits.per_day))
        size = len(self.times)
        log = np.concatenate([self.times, np.empty(n + 1, dtype=np.int64)])
        allowed = np.zeros(n, dtype=bool)
        in_front = np.zeros(n, dtype=np.int64)
        i = 0
        while i < n:
            count = min(block, n - i)
            room = np.maximum(
                self._room_from(log, size, count, limits.per_minute, limits.minute_span),
                self._room_from(log, size, count, limits.per_day, limits.day_span),
            )
            refused = np.flatnonzero(at[i : i + count] < room)
            run = int(refused[0]) if len(refused) else count
            allowed[i : i + run] = True
            in_front[i : i + run] = np.arange(size, size + run)
            log[size : size + run] = at[i : i + run]
            size, i = size + run, i + run
            if len(refused):
                end = i + int(np.searchsorted(at[i:], room[run], side="left"))
                in_front[i:end] = size
                i = end
        # Calls of the last minute in front of each call lie between these two places of the log.
        oldest = np.searchsorted(log[:size], at - limits.minute_span, side="right")
        in_minute = in_front - oldest
        remaining = np.where(allowed, limits.per_minute - 1 - in_minute, 0).astype(np.int32)
        full = ~allowed & (in_minute >= limits.per_minute) & (in_minute > 0)
        reset = (np.where(full, log[oldest], at) + limits.minute_span) // MICROS
        wait = np.where(allowed, 0, np.maximum(reset - at // MICROS, 1)).astype(np.int32)
        self.times = log[:0]
        self.admit(log[:size])
        return allowed, remaining, reset, wait


def _slot(micros: Column, limits: Limits) -> Column:
    return F.call_function("div", micros, F.lit(max(limits.minute_span, limits.longest_span // SLOTS_PER_WINDOW, 1)))


def stretches(loads: DataFrame, limits: Limits, key: str) -> DataFrame:
    """The parts of each key that must be replayed: ``key, after, start, until`` in microseconds.

    ``loads`` has ``key, at, minute_load, day_load``. Calls at ``start`` or later and before ``until`` are to be replayed;
    those later than ``after`` and before ``start`` are admitted for certain and all that the first ones depend on.
    Neither kind of range overlaps with its like. No row means that nothing is contested.
    """
    depends = F.when(F.col("day_load") > limits.per_day, F.lit(limits.longest_span)).otherwise(F.lit(limits.minute_span))
    contested = loads.filter((F.col("minute_load") > limits.per_minute) | (F.col("day_load") > limits.per_day))
    slots = contested.groupBy(key, _slot(F.col("at"), limits).alias("_slot")).agg(
        F.min("at").alias("_first"), F.max("at").alias("_last"), F.min(F.col("at") - depends).alias("_after")
    )
    # Newest first: the frame holds what this slot and all later ones depend on, the next row is the slot before.
    newest = Window.partitionBy(key).orderBy(F.desc("_slot"))
    slots = slots.select(
        "*",
        F.min("_after").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_needed"),
        F.lead("_last").over(newest).alias("_before"),
    )
    cut = F.col("_before").isNull() | (F.col("_before") <= F.col("_needed"))
    oldest = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = slots.withColumn("_stretch", F.sum(cut.cast("long")).over(oldest))
    # The minute after the last contested call: what remains there depends on which calls were refused.
    return numbered.groupBy(key, "_stretch").agg(
        F.min("_after").alias("after"),
        F.min("_first").alias("start"),
        (F.max("_last") + F.lit(limits.minute_span)).alias("until"),
    ).drop("_stretch")


def _by_slot(ranges: DataFrame, low: Column, limits: Limits) -> DataFrame:
    """One row per slot from ``low`` to the end of a range, so that calls are joined by key and slot."""
    return ranges.withColumn("_slot", F.explode(F.sequence(_slot(low, limits), _slot(F.col("until") - 1, limits))))


def _replay_sorted(limits: Limits, key: str, ident: str):
    """Function for ``mapInPandas`` over rows sorted by key, stretch, time, id; rows before the stretch are seeds."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, AdmittedLog(limits)
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            keys, at, starts = pdf[key].to_numpy(), pdf["at"].to_numpy(), pdf["start"].to_numpy()
            calls = at >= starts
            decisions = [np.zeros(n, dtype=t) for t in (bool, np.int32, np.int64, np.int32)]
            changes = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1]) | (calls[1:] != calls[:-1])
            bounds = [0, *(np.flatnonzero(changes) + 1), n]
            for low, high in zip(bounds, bounds[1:]):
                if current != (keys[low], starts[low]):
                    current, log = (keys[low], starts[low]), AdmittedLog(limits)
                if not calls[low]:
                    log.admit(at[low:high])
                    continue
                for column, values in zip(decisions, log.decide(at[low:high])):
                    column[low:high] = values
            columns = {key: keys, ident: pdf[ident].to_numpy(), "at": at, **dict(zip(DECISION_COLUMNS, decisions))}
            yield pd.DataFrame(columns)[calls]

    return replay


def replay_rows(loads: DataFrame, ranges: DataFrame, limits: Limits, key: str, ident: str) -> DataFrame:
    """The calls to replay with the seeds of their stretch: ``key, ident, at, start``."""
    parts = _by_slot(ranges, F.col("after") + 1, limits)
    calls = loads.select(key, ident, "at", _slot(F.col("at"), limits).alias("_slot"))
    inside = (F.col("at") > F.col("after")) & (F.col("at") < F.col("until"))
    return calls.join(parts, [key, "_slot"]).filter(inside).select(key, ident, "at", "start")


def audit(
    calls: DataFrame,
    limits: Limits = Limits(),
    key: str = "api_key_id",
    ident: str = "id",
    time: str = "created_at",
) -> DataFrame:
    """Decision of the limiter on every call with a key: ``key, id, time`` and ``DECISION_COLUMNS``.

    Writes the loads and the stretches to the shared folder. The windows of ``limits`` are at least one second.
    """
    loads = offered_load(
        calls.select(key, ident, time),
        {"minute_load": limits.minute_seconds, "day_load": limits.day_seconds},
        key,
        time,
        tie_break=ident,
    )
    loads = written(loads.select(key, ident, F.unix_micros(time).alias("at"), "minute_load", "day_load"), "limiter-loads")
    ranges = written(stretches(loads, limits, key), "limiter-stretches")

    cores = _by_slot(ranges, F.col("start"), limits).alias("c")
    calls_by_slot = loads.withColumn("_slot", _slot(F.col("at"), limits)).alias("l")
    inside = (
        (F.col(f"l.{key}") == F.col(f"c.{key}"))
        & (F.col("l._slot") == F.col("c._slot"))
        & (F.col("l.at") >= F.col("c.start"))
        & (F.col("l.at") < F.col("c.until"))
    )
    certain = calls_by_slot.join(cores, inside, "left_anti").select(
        key,
        ident,
        "at",
        F.lit(True).alias("allowed"),
        (F.lit(limits.per_minute) - F.col("minute_load")).cast("int").alias("remaining"),
        F.call_function("div", F.col("at") + F.lit(limits.minute_span), F.lit(MICROS)).alias("reset_at"),
        F.lit(0).alias("retry_after"),
    )
    types = {c: calls.schema[c].dataType.simpleString() for c in (key, ident)}
    replayed = (
        replay_rows(loads, ranges, limits, key, ident)
        .repartition(key, "start")
        .sortWithinPartitions(key, "start", "at", ident)
        .mapInPandas(
            _replay_sorted(limits, key, ident),
            f"{key} {types[key]}, {ident} {types[ident]}, at bigint, allowed boolean, "
            "remaining int, reset_at bigint, retry_after int",
        )
    )
    return certain.unionByName(replayed).select(key, ident, F.timestamp_micros("at").alias(time), *DECISION_COLUMNS)
