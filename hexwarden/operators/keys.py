"""The registry of API keys: checking, usage counters, revocation, new keys."""

from pyspark.sql import DataFrame, functions as F

from hexwarden.functions.clock import AsOf, as_of_column
from hexwarden.functions.texts import KEY_PREFIX_CHARS, cut, strip
from hexwarden.operators.ids import highest_id, with_dense_ids


def check_keys(presented: DataFrame, api_keys: DataFrame, strip_text: bool = True) -> DataFrame:
    """Add ``valid, key_prefix, id, name`` to presented keys (column ``api_key``).

    A key is known by its SHA-256 and must be active. The validation entry strips white space first;
    the request entry (``strip_text=False``) does not.
    """
    text = F.col("api_key")
    hashed = presented.withColumn("_hash", F.sha2(strip(text) if strip_text else text, 256))
    active = api_keys.filter("is_active").select(F.col("key_hash").alias("_hash"), "key_prefix", "id", "name")
    return (
        hashed.join(active, "_hash", "left")
        .withColumn("valid", F.col("id").isNotNull())
        .select(*presented.columns, "valid", "key_prefix", "id", "name")
    )


def usage_per_key(request_log: DataFrame) -> DataFrame:
    """Counted calls and last use per key; calls without a key do not count."""
    return (
        request_log.filter(F.col("api_key_id").isNotNull())
        .groupBy("api_key_id")
        .agg(F.count(F.lit(1)).alias("requests"), F.max("created_at").alias("last_used_at"))
    )


def usage_per_key_and_day(request_log: DataFrame) -> DataFrame:
    """Calls per key and calendar day."""
    return (
        request_log.filter(F.col("api_key_id").isNotNull())
        .groupBy("api_key_id", F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def count_usage(api_keys: DataFrame, request_log: DataFrame, as_of: AsOf = None, daily: bool = False) -> DataFrame:
    """New snapshot with the logged calls added to the counters.

    By default both counters only ever grow. With ``daily`` the day counter holds the calls on the day
    of ``as_of`` instead.
    """
    today = F.to_date("created_at") == F.to_date(as_of_column(as_of))
    used = (
        request_log.filter(F.col("api_key_id").isNotNull())
        .groupBy(F.col("api_key_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max("created_at").alias("_last"), F.count_if(today).alias("_today"))
    )
    rows = api_keys.join(used, "id", "left")
    added = F.coalesce("_n", F.lit(0))
    if daily:
        rows = rows.withColumn("requests_today", F.coalesce("_today", F.lit(0)))
    else:
        rows = rows.withColumn("requests_today", F.col("requests_today") + added)
    return (
        rows.withColumn("requests_total", F.col("requests_total") + added)
        .withColumn("last_used_at", F.greatest("last_used_at", "_last"))
        .select(api_keys.columns)
    )


def revoke_keys(api_keys: DataFrame, revocations: DataFrame) -> DataFrame:
    """New snapshot with the listed keys (column ``key_id``) inactive."""
    gone = revocations.select(F.col("key_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    return (
        api_keys.join(gone, "id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_gone").isNull())
        .select(api_keys.columns)
    )


def revocation_outcomes(api_keys: DataFrame, revocations: DataFrame) -> DataFrame:
    """Add ``found`` to the revocation requests."""
    known = api_keys.select(F.col("id").alias("key_id"), F.lit(True).alias("_known"))
    return (
        revocations.join(known, "key_id", "left")
        .withColumn("found", F.col("_known").isNotNull())
        .select(*revocations.columns, "found")
    )


def add_keys(batch: DataFrame, api_keys: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Registry rows of new keys (``api_key, name`` and optional ``waitlist_id``); only the hash and the
    first characters of a key are kept. A hash that is stored already, or comes twice, is added once."""
    waitlist_id = F.col("waitlist_id") if "waitlist_id" in batch.columns else F.lit(None)
    rows = batch.select(
        F.sha2("api_key", 256).alias("key_hash"),
        cut(F.col("api_key"), KEY_PREFIX_CHARS).alias("key_prefix"),
        "name",
        waitlist_id.cast("bigint").alias("waitlist_id"),
    )
    once = rows.groupBy("key_hash").agg(F.min(F.struct("key_prefix", "name", "waitlist_id")).alias("row"))
    new = once.join(api_keys.select("key_hash"), "key_hash", "left_anti").select("key_hash", "row.*")
    return with_dense_ids(new, "key_hash", highest_id(api_keys)).select(
        "id",
        "key_hash",
        "key_prefix",
        "name",
        "waitlist_id",
        F.lit(True).alias("is_active"),
        F.lit(0).cast("bigint").alias("requests_today"),
        F.lit(0).cast("bigint").alias("requests_total"),
        F.lit(None).cast("timestamp").alias("last_used_at"),
        as_of_column(as_of).alias("created_at"),
    )
