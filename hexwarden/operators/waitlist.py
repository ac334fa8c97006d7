"""Applications for access and the decisions on them, as batches."""

from pyspark.sql import DataFrame, functions as F

from hexwarden.functions.clock import AsOf, as_of_column
from hexwarden.functions.rules import application_errors
from hexwarden.operators.ids import highest_id, with_dense_ids
from hexwarden.operators.registry import ACCEPTED, admit

PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"
APPROVE, REJECT = "approve", "reject"

# Outcomes of a decision.
DONE, NOT_FOUND, REFUSED = "done", "not found", "already rejected"


def application_outcomes(batch: DataFrame, waitlist: DataFrame) -> DataFrame:
    """Outcome of every application (``request_id, email`` and optional fields, ids in arrival order)."""
    fields = {c: F.col(c) for c in ("name", "project", "twitter", "goal") if c in batch.columns}
    return admit(
        batch,
        waitlist.select(F.lower("email").alias("_key")),
        F.col("email"),
        application_errors(F.col("email"), fields),
        ("request_id",),
    )


def add_applications(batch: DataFrame, waitlist: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Waitlist rows of the accepted applications; the goal is not stored."""
    accepted = application_outcomes(batch, waitlist).filter(F.col("outcome") == ACCEPTED)
    numbered = with_dense_ids(accepted.withColumn("_key", F.lower("email")), "_key", highest_id(waitlist))
    optional = [
        (F.col(c) if c in batch.columns else F.lit(None).cast("string")).alias(c)
        for c in ("name", "project", "twitter")
    ]
    return numbered.select(
        "id",
        "email",
        *optional,
        F.lit(PENDING).alias("status"),
        F.lit(None).cast("bigint").alias("api_key_id"),
        as_of_column(as_of).alias("applied_at"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
    )


def decision_outcomes(waitlist: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add ``outcome`` to decisions (``decision_id, waitlist_id, action, api_key_id, decided_at``).

    A rejected application stays rejected: approving it is refused from its first rejection on. Approving
    twice and rejecting in any state are allowed. So an outcome depends only on the time of the first
    rejection, which an aggregate finds; no ordered pass over all decisions on a row is needed.
    """
    at = F.struct("decided_at", "decision_id")
    first_reject = (
        decisions.filter(F.col("action") == REJECT).groupBy("waitlist_id").agg(F.min(at).alias("_rejected_at"))
    )
    state = waitlist.select(F.col("id").alias("waitlist_id"), F.col("status").alias("_status")).join(
        first_reject, "waitlist_id", "left"
    )
    late = (F.col("_status") == REJECTED) | F.coalesce(at > F.col("_rejected_at"), F.lit(False))
    outcome = (
        F.when(F.col("_status").isNull(), F.lit(NOT_FOUND))
        .when((F.col("action") == APPROVE) & late, F.lit(REFUSED))
        .otherwise(F.lit(DONE))
    )
    return (
        decisions.join(state, "waitlist_id", "left")
        .withColumn("outcome", outcome)
        .select(*decisions.columns, "outcome")
    )


def decide(waitlist: DataFrame, decisions: DataFrame) -> DataFrame:
    """New snapshot after the decisions: status, key of the last approval (else the old one), time."""
    done = decision_outcomes(waitlist, decisions).filter(F.col("outcome") == DONE)
    at = F.struct("decided_at", "decision_id")
    approved = (F.col("action") == APPROVE) & F.col("api_key_id").isNotNull()
    result = done.groupBy(F.col("waitlist_id").alias("id")).agg(
        F.max(F.col("action") == REJECT).alias("_rejected"),
        F.max(F.when(approved, F.struct("decided_at", "decision_id", "api_key_id"))).alias("_approval"),
        F.max(at).alias("_last"),
    )
    status = (
        F.when(F.col("_rejected").isNull(), F.col("status"))
        .when(F.col("_rejected"), F.lit(REJECTED))
        .otherwise(F.lit(APPROVED))
    )
    return (
        waitlist.join(result, "id", "left")
        .withColumn("status", status)
        .withColumn("api_key_id", F.coalesce("_approval.api_key_id", "api_key_id"))
        .withColumn("reviewed_at", F.coalesce("_last.decided_at", "reviewed_at"))
        .select(waitlist.columns)
    )
