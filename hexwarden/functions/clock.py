"""Time: every operator that needs "now" takes it as ``as_of``."""

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AsOf = Column | datetime | str | None


def as_of_column(as_of: AsOf = None) -> Column:
    """The clock as a timestamp column; the time of the query if none is given."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
            return F.lit(as_of.isoformat(sep=" ") + "Z").cast("timestamp")
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp")


def relative_age(when: Column, as_of: AsOf = None) -> Column:
    """``12s ago``, ``3m ago``, ``5h ago``: rounded down, never negative; a dash without a time."""
    micros = F.unix_micros(as_of_column(as_of)) - F.unix_micros(when)
    seconds = F.greatest(F.lit(0), F.floor(micros / F.lit(1_000_000)))
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    return (
        F.when(when.isNull(), F.lit("—"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h ago")))
    )


def on_day_of(when: Column, as_of: AsOf = None) -> Column:
    """Same calendar day as the clock. Spark turns the cast into a pushed time range."""
    return F.to_date(when) == F.to_date(as_of_column(as_of))


def calendar(spark: SparkSession, as_of: AsOf = None, days: int = 7) -> DataFrame:
    """The last ``days`` days up to the clock's day, one row each, column ``day``."""
    last = F.to_date(as_of_column(as_of))
    series = F.sequence(F.date_sub(last, days - 1), last)
    return spark.range(1).select(F.explode(series).alias("day"))


def within_days(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows created on the days ``first`` to ``last``; of a table cut by ``day`` only those folders are opened."""
    df = df.filter(F.to_date("created_at").between(first, last))
    return df.filter(F.col("day").between(first, last)) if "day" in df.columns else df
