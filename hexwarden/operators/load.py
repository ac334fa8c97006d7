"""Sliding-window load per key, for keys of any size.

A range window partitioned by key would put all calls of a key into one task. Instead a call counts +1 at
its time and -1 when it leaves the window, and the load is the running total of these steps. Each key's
timeline is cut into slots: totals run inside a slot, and a slot starts from the sum of the earlier ones,
which is taken over one row per key and slot, however many calls the slot holds.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

MICROS = 1_000_000
# A task takes the calls of one key in one slot; the sums of a key take one row per slot with calls.
SLOT_SECONDS = 60
ENTER = 0


def running_totals(
    df: DataFrame, keys: list[str], slot: str, order: list[Column], values: dict[str, Column], by_row: bool
) -> DataFrame:
    """Add running totals of ``values`` per key in ``order``; ``slot`` must rise with that order.

    ``by_row`` counts up to the row itself, otherwise rows that tie in ``order`` count together.
    """
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    sums = df.groupBy(*keys, slot).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, slot, *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, slot).orderBy(*order)
    frame = inside.rowsBetween if by_row else inside.rangeBetween
    inside = frame(Window.unboundedPreceding, Window.currentRow)
    totals = df.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_t_{n}") for n in values])
    joined = totals.join(offsets, [*keys, slot])
    for name in values:
        joined = joined.withColumn(name, F.col(f"_t_{name}") + F.col(f"_o_{name}"))
    return joined.drop(*[f"_{kind}_{n}" for n in values for kind in "vto"])


def offered_load(
    calls: DataFrame,
    windows: dict[str, int],
    key: str = "api_key_id",
    time: str = "created_at",
    tie_break: str | None = None,
    slot_seconds: int = SLOT_SECONDS,
    sequence: str | None = None,
) -> DataFrame:
    """Add to each call the number of calls of its key in the last ``windows[name]`` seconds.

    A window is ``(t - length, t]`` and includes the call itself. Calls at the same time all count, or, with
    ``tie_break``, only those up to the call in that order. ``sequence`` names a further column for the
    position of the call among all calls of its key.
    """
    moment = F.unix_micros(F.col(time))
    steps = [F.struct(F.lit(ENTER).alias("_kind"), moment.alias("_at"))]
    steps += [
        F.struct(F.lit(n).alias("_kind"), (moment + F.lit(seconds * MICROS)).alias("_at"))
        for n, seconds in enumerate(windows.values(), start=1)
    ]
    rows = (
        calls.filter(F.col(key).isNotNull())
        .withColumn("_step", F.explode(F.array(*steps)))
        .select("*", "_step._kind", "_step._at")
        .drop("_step")
        .withColumn("_slot", F.call_function("div", F.col("_at"), F.lit(slot_seconds * MICROS)))
    )
    kind = F.col("_kind")
    values = {
        name: F.when(kind == ENTER, 1).when(kind == n, -1).otherwise(0)
        for n, name in enumerate(windows, start=1)
    }
    if sequence is not None:
        values[sequence] = F.when(kind == ENTER, 1).otherwise(0)
    # At one moment calls leave before others enter: a call as old as the window no longer counts.
    order = [F.col("_at")]
    if tie_break is not None:
        order += [(kind == ENTER).cast("int"), F.col(tie_break)]
    totals = running_totals(rows, [key], "_slot", order, values, by_row=tie_break is not None)
    names = list(windows) + ([sequence] if sequence else [])
    return totals.filter(kind == ENTER).select(*calls.columns, *names)
