"""Changes to the registry of watched protocols, as batches."""

from pyspark.sql import Column, DataFrame, functions as F

from hexwarden.functions.clock import AsOf, as_of_column
from hexwarden.functions.rules import protocol_errors
from hexwarden.operators.ids import highest_id, with_dense_ids

ACCEPTED = "accepted"
EXISTS = "exists"
REPEATED = "repeated in batch"




def admit(batch: DataFrame, stored_keys: DataFrame, key: Column, errors: Column, arrival: tuple[str, ...]) -> DataFrame:
    """Add ``outcome`` and ``errors`` to requests for new rows with a case-insensitive unique key.

    Invalid rows are told so; of the valid ones, the first per key is accepted unless the key is stored.
    The rank is taken per key with its copies, so the copies of a key first shrink to the first arrival
    in an aggregate and only that is compared.
    """
    checked = batch.withColumn("errors", errors).withColumn("_key", F.lower(key))
    valid = F.size("errors") == 0
    first = (
        checked.filter(valid)
        .groupBy("_key")
        .agg(F.min(F.struct(*arrival)).alias("_first"))
    )
    known = stored_keys.distinct().withColumn("_known", F.lit(True))
    outcome = (
        F.when(~valid, F.lit("invalid"))
        .when(F.col("_known").isNotNull(), F.lit(EXISTS))
        .when(F.struct(*arrival) != F.col("_first"), F.lit(REPEATED))
        .otherwise(F.lit(ACCEPTED))
    )
    return (
        checked.join(first.join(known, "_key", "left"), "_key", "left")
        .withColumn("outcome", outcome)
        .select(*batch.columns, "errors", "outcome")
    )


def registration_outcomes(batch: DataFrame, protocols: DataFrame) -> DataFrame:
    """Outcome of every registration request (``request_id, name, address``, ids in order of arrival)."""
    return admit(
        batch,
        protocols.select(F.lower("address").alias("_key")),
        F.col("address"),
        protocol_errors(F.col("name"), F.col("address")),
        ("request_id",),
    )


def register_protocols(batch: DataFrame, protocols: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Registry rows of the accepted requests, ids above the highest one in use."""
    accepted = registration_outcomes(batch, protocols).filter(F.col("outcome") == ACCEPTED)
    numbered = with_dense_ids(accepted.withColumn("_key", F.lower("address")), "_key", highest_id(protocols))
    return numbered.select(
        "id",
        "name",
        "address",
        F.lit("ethereum").alias("chain"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("bigint").alias("last_seen_block"),
        as_of_column(as_of).alias("created_at"),
    )


def toggle_protocols(protocols: DataFrame, toggles: DataFrame) -> DataFrame:
    """New snapshot after the toggle requests (column ``protocol_id``): an odd number flips the flag."""
    odd = (
        toggles.groupBy(F.col("protocol_id").alias("id"))
        .agg((F.count(F.lit(1)) % 2 == 1).alias("_odd"))
        .filter("_odd")
    )
    return (
        protocols.join(odd, "id", "left")
        .withColumn("is_active", F.col("is_active") != F.col("_odd").isNotNull())
        .select(protocols.columns)
    )


def delete_protocols(
    protocols: DataFrame, transactions: DataFrame, alerts: DataFrame, deletions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New snapshots of the three tables without the deleted protocols (column ``protocol_id``),
    their transactions and the alerts of those."""
    gone = deletions.select("protocol_id").distinct()
    kept_protocols = protocols.join(gone, protocols["id"] == gone["protocol_id"], "left_anti")
    kept_transactions = transactions.join(gone, "protocol_id", "left_anti").select(transactions.columns)
    # Only the transactions to be deleted are looked for, not all that stay.
    lost = transactions.join(gone, "protocol_id", "left_semi").select(F.col("id").alias("transaction_id"))
    kept_alerts = alerts.join(lost, "transaction_id", "left_anti").select(alerts.columns)
    return kept_protocols, kept_transactions, kept_alerts
