"""Lists, lookups and feeds. Every order ends with the id, so equal times have one fixed order."""

from pyspark.sql import Column, DataFrame, functions as F

from hexwarden.functions.clock import AsOf, relative_age
from hexwarden.functions.risk import risk_band
from hexwarden.functions.texts import alert_text, fixed_decimals, shorten

# Default and largest row counts of the feeds.
TRANSACTIONS_SHOWN, TRANSACTIONS_MAX = 50, 200
ALERTS_SHOWN, ALERTS_MAX = 100, 500
DEMO_SHOWN, DEMO_MAX = 10, 25
STRIP_SHOWN = 12
HISTORY_SHOWN = 200

TRANSACTION_VIEW = (
    "id", "tx_hash", "from_address", "to_address", "value_eth", "risk_score", "risk_summary", "fetched_at",
)
PROTOCOL_VIEW = ("id", "name", "address", "chain", "is_active", "created_at", "last_seen_block")
WAITLIST_VIEW = (
    "id", "email", "name", "project", "twitter", "status", "api_key_id", "applied_at", "reviewed_at",
)
KEY_VIEW = (
    "id", "key_prefix", "name", "is_active", "requests_today", "requests_total", "last_used_at", "created_at",
)


def clamp(limit: int, most: int) -> int:
    return min(max(limit, 1), most)


def newest(df: DataFrame, time: str) -> list[Column]:
    return [F.desc(time), F.desc("id")]


# Protocols


def protocol_list(protocols: DataFrame, active_only: bool = False) -> DataFrame:
    """Protocols, newest first."""
    rows = protocols.filter("is_active") if active_only else protocols
    return rows.select(*PROTOCOL_VIEW).orderBy(*newest(rows, "created_at"))


def protocol_by_id(protocols: DataFrame, protocol_id: int) -> DataFrame:
    return protocols.filter(F.col("id") == protocol_id)


def _same_text(df: DataFrame, name: str, wanted: str | Column) -> Column:
    stored = F.col(f"{name}_lc") if f"{name}_lc" in df.columns else F.lower(name)
    return stored == F.lower(F.lit(wanted) if isinstance(wanted, str) else wanted)


def protocol_by_address(protocols: DataFrame, address: str | Column) -> DataFrame:
    """Lookup without regard to case. A stored ``address_lc`` column is used if there is one, as the
    comparison then reaches the Parquet scan."""
    return protocols.filter(_same_text(protocols, "address", address))


def shown_protocol(protocols: DataFrame) -> DataFrame:
    """The protocol a dashboard opens with: the newest active one, else the newest."""
    return protocols.select(*PROTOCOL_VIEW).orderBy(F.desc("is_active"), *newest(protocols, "created_at")).limit(1)


# Transactions


def transaction_by_hash(transactions: DataFrame, tx_hash: str) -> DataFrame:
    """Lookup with regard to case."""
    return transactions.filter(F.col("tx_hash") == tx_hash)


def recent_transactions(
    transactions: DataFrame, protocol_id: int | None = None, limit: int = TRANSACTIONS_SHOWN
) -> DataFrame:
    """Newest transactions, of one protocol or all."""
    rows = transactions if protocol_id is None else transactions.filter(F.col("protocol_id") == protocol_id)
    return (
        rows.select(*TRANSACTION_VIEW)
        .orderBy(*newest(rows, "fetched_at"))
        .limit(clamp(limit, TRANSACTIONS_MAX))
    )


def shown_transaction_count(transactions: DataFrame, protocol_id: int | None = None) -> DataFrame:
    """How many transactions the dashboard shows."""
    return recent_transactions(transactions, protocol_id).agg(F.count(F.lit(1)).alias("transactions"))


def transaction_rows(recent: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Table form of a transaction feed: shortened texts, fixed decimals, band, age."""
    return recent.select(
        "id",
        shorten(F.col("tx_hash")).alias("tx"),
        shorten(F.col("from_address")).alias("sender"),
        fixed_decimals(F.col("value_eth"), 5).alias("value"),
        "risk_score",
        risk_band(F.col("risk_score")).alias("band"),
        relative_age(F.col("fetched_at"), as_of).alias("age"),
    )


def demo_feed(transactions: DataFrame, limit: int = DEMO_SHOWN) -> DataFrame:
    """Public feed of the newest transactions."""
    recent = recent_transactions(transactions, limit=min(limit, DEMO_MAX))
    return recent.select(
        "id",
        shorten(F.col("tx_hash"), empty="0x...").alias("tx"),
        fixed_decimals(F.col("value_eth"), 3).alias("value"),
        "risk_score",
        risk_band(F.col("risk_score")).alias("band"),
    )


# Alerts


def recent_alerts(
    alerts: DataFrame,
    transactions: DataFrame,
    protocols: DataFrame,
    limit: int = ALERTS_SHOWN,
    keys_enforced: bool = False,
) -> DataFrame:
    """Newest alerts with hash and protocol name.

    Alerts without a transaction or protocol are dropped before the newest are picked: Parquet enforces no
    keys. Where the caller knows that every alert has both (``keys_enforced``), the newest are picked before
    the joins, and the big table is scanned for a few hundred ids.
    """
    count = clamp(limit, ALERTS_MAX)
    order = newest(alerts, "created_at")
    if keys_enforced:
        # At most 500 rows.
        alerts = F.broadcast(alerts.orderBy(*order).limit(count))
    hashes = transactions.select(F.col("id").alias("transaction_id"), "tx_hash", "protocol_id")
    names = protocols.select(F.col("id").alias("protocol_id"), F.col("name").alias("protocol_name"))
    return (
        hashes.join(alerts, "transaction_id")
        .join(names, "protocol_id")
        .select(
            "id",
            "transaction_id",
            "tx_hash",
            "protocol_name",
            "risk_score",
            "risk_summary",
            "telegram_sent",
            "created_at",
        )
        .orderBy(*order)
        .limit(count)
    )


def alert_strip(alerts: DataFrame, transactions: DataFrame, protocols: DataFrame) -> DataFrame:
    """The newest alerts as short chips."""
    rows = recent_alerts(alerts, transactions, protocols, STRIP_SHOWN)
    return rows.select(
        "id",
        "risk_score",
        risk_band(F.col("risk_score")).alias("band"),
        alert_text(F.col("risk_summary")).alias("text"),
    )


def alert_range(
    alerts: DataFrame, transactions: DataFrame, protocols: DataFrame, low: int = 0, high: int = 100
) -> DataFrame:
    """Alerts with a score in the range, among the newest 200 (the range does not reach further back)."""
    return recent_alerts(alerts, transactions, protocols, HISTORY_SHOWN).filter(
        F.col("risk_score").between(low, high)
    )


# Keys and waitlist


def key_list(api_keys: DataFrame) -> DataFrame:
    """Keys without their hash, newest first."""
    return api_keys.select(*KEY_VIEW).orderBy(*newest(api_keys, "created_at"))


def active_key_by_hash(api_keys: DataFrame, key_hash: str) -> DataFrame:
    return api_keys.filter((F.col("key_hash") == key_hash) & F.col("is_active"))


def top_keys(api_keys: DataFrame, count: int = 10) -> DataFrame:
    """Keys with the most calls."""
    return (
        api_keys.select("id", "key_prefix", "name", "requests_today")
        .orderBy(F.desc("requests_today"), F.asc("id"))
        .limit(count)
        .drop("id")
    )


def waitlist_list(waitlist: DataFrame) -> DataFrame:
    """Applications, newest first."""
    return waitlist.select(*WAITLIST_VIEW).orderBy(*newest(waitlist, "applied_at"))


def waitlist_by_email(waitlist: DataFrame, email: str | Column) -> DataFrame:
    """Lookup without regard to case, by ``email_lc`` if there is one."""
    return waitlist.filter(_same_text(waitlist, "email", email))
