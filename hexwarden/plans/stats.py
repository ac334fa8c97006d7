"""Counts, histograms and series. Each table is read once per report."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexwarden.functions.clock import AsOf, as_of_column, calendar, on_day_of, within_days
from hexwarden.functions.risk import HISTOGRAM, is_scored, risk_band
from hexwarden.functions.texts import email_domain
from hexwarden.operators.waitlist import APPROVED, PENDING, REJECTED
from hexwarden.plans.feeds import top_keys

DAYS_SHOWN = 7
UPTIME_DAYS = 1  # Fixed value.


def _counts(**tests: Column) -> list[Column]:
    return [F.count_if(test).alias(name) for name, test in tests.items()]


def _one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row count tables side by side, as the sum of their union."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.sum(c).alias(c) for c in stacked.columns])


def alert_stats(alerts: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Alerts of the calendar day, of the last 7 times 24 hours, and of all time.

    The week has no upper end: rows dated after ``as_of`` count.
    """
    week_ago = as_of_column(as_of) - F.expr("INTERVAL 7 DAYS")
    return alerts.agg(
        *_counts(today=on_day_of(F.col("created_at"), as_of), this_week=F.col("created_at") >= week_ago),
        F.count(F.lit(1)).alias("all_time"),
    )


def public_stats(protocols: DataFrame, transactions: DataFrame, alerts: DataFrame) -> DataFrame:
    counts = _one_row(
        protocols.agg(*_counts(protocols_monitored=F.col("is_active"))),
        transactions.agg(*_counts(transactions_scored=is_scored(F.col("risk_score")))),
        alerts.agg(F.count(F.lit(1)).alias("alerts_fired")),
    )
    return counts.withColumn("uptime_days", F.lit(UPTIME_DAYS))


def requests_on_day(request_log: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Logged requests on the day of ``as_of``. The day is a filter, so the scan skips other days."""
    day = F.to_date(as_of_column(as_of))
    return within_days(request_log, day, day).agg(F.count(F.lit(1)).alias("requests_today"))


def admin_overview(
    api_keys: DataFrame,
    waitlist: DataFrame,
    protocols: DataFrame,
    transactions: DataFrame,
    alerts: DataFrame,
    request_log: DataFrame,
    as_of: AsOf = None,
) -> DataFrame:
    """Seven counts over six tables."""
    rows = F.count(F.lit(1))
    return _one_row(
        api_keys.agg(rows.alias("total_api_keys"), *_counts(active_api_keys=F.col("is_active"))),
        waitlist.agg(*_counts(waitlist_pending=F.col("status") == PENDING)),
        protocols.agg(rows.alias("protocols_monitored")),
        transactions.agg(*_counts(transactions_scored_total=is_scored(F.col("risk_score")))),
        alerts.agg(rows.alias("alerts_fired_total")),
        requests_on_day(request_log, as_of),
    )


def risk_histogram(transactions: DataFrame) -> DataFrame:
    """Scored transactions per band; scores outside 0..100 are in none."""
    score = F.col("risk_score")
    return transactions.agg(*_counts(**{name: score.between(*ends) for name, ends in HISTOGRAM.items()}))


def risk_bands(transactions: DataFrame) -> DataFrame:
    """Transactions per label; here every score has one."""
    return transactions.groupBy(risk_band(F.col("risk_score")).alias("band")).agg(
        F.count(F.lit(1)).alias("transactions")
    )


def daily_requests(spark: SparkSession, request_log: DataFrame, as_of: AsOf = None, days: int = DAYS_SHOWN) -> DataFrame:
    """Requests on each of the last days, oldest first, zero where there are none.

    Only those days are read, and they are counted before the calendar is joined.
    """
    last = F.to_date(as_of_column(as_of))
    when = F.to_date("created_at")
    counted = (
        within_days(request_log, F.date_sub(last, days - 1), last)
        .groupBy(when.alias("day"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return (
        calendar(spark, as_of, days)
        .join(counted, "day", "left")
        .select(F.date_format("day", "yyyy-MM-dd").alias("date"), F.coalesce("requests", F.lit(0)).alias("requests"))
        .orderBy("date")
    )


def waitlist_counts(waitlist: DataFrame) -> DataFrame:
    """Applications in each of the three states."""
    return waitlist.agg(*_counts(**{s: F.col("status") == s for s in (PENDING, APPROVED, REJECTED)}))


def waitlist_domains(waitlist: DataFrame) -> DataFrame:
    """Applications per e-mail domain."""
    return waitlist.groupBy(email_domain(F.col("email")).alias("domain")).agg(F.count(F.lit(1)).alias("applications"))


def admin_metrics(
    spark: SparkSession,
    api_keys: DataFrame,
    waitlist: DataFrame,
    protocols: DataFrame,
    transactions: DataFrame,
    alerts: DataFrame,
    request_log: DataFrame,
    as_of: AsOf = None,
) -> dict[str, DataFrame]:
    """The four parts of the administration report."""
    return {
        "overview": admin_overview(api_keys, waitlist, protocols, transactions, alerts, request_log, as_of),
        "top_keys_by_usage": top_keys(api_keys),
        "daily_requests_last_7_days": daily_requests(spark, request_log, as_of),
        "risk_score_distribution": risk_histogram(transactions),
    }
