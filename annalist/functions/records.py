"""Validation of ledger records and their delivery form."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed vocabularies.
OPERATIONS = ("Seeded", "Set", "Transitioned", "Refreshed", "Invalidated", "Cleared", "Faulted", "Imported")
STATUSES = ("Absent", "Ready", "Stale", "Invalidated", "Cleared", "Faulted")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


#: Each rule with the condition that violates it, over columns of a record.
RULES = {
    "revision": lambda: F.col("revision").isNull() | (F.col("revision") <= 0),
    "global_position": lambda: F.col("global_position").isNull() | (F.col("global_position") <= 0),
    "occurred_at": lambda: F.col("occurred_at").isNull(),
    "status_absent": lambda: F.col("status").isNull() | (F.col("status") == "Absent"),
    "value_type": lambda: _blank("value_type"),
    "schema_version": lambda: F.col("schema_version").isNull() | (F.col("schema_version") <= 0),
    "source": lambda: _blank("source"),
    "payload_required": lambda: F.col("status").isin("Ready", "Stale") & ~F.col("has_value"),
    "payload_forbidden": lambda: (F.col("status") == "Cleared") & F.col("has_value"),
    "serve_window": lambda: F.col("serve_until") < F.col("fresh_until"),
}
#: A commit has no revision, position or time yet.
COMMIT_RULES = ("status_absent", "value_type", "schema_version", "source", "payload_required", "payload_forbidden", "serve_window")


def validate(records: DataFrame, rules=tuple(RULES)) -> DataFrame:
    """All columns, and violations: the names of the rules a record breaks."""
    broken = F.array(*(F.when(F.coalesce(RULES[r](), F.lit(False)), F.lit(r)) for r in rules))
    return records.withColumn("violations", F.array_compact(broken))


def violations_of(rows: DataFrame, invariants: dict) -> DataFrame:
    """All columns, and violated: the first of the named invariants (name: predicate column) that does not hold."""
    first = F.coalesce(*(F.when(~F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in invariants.items()))
    return rows.withColumn("violated", first)


def message(records: DataFrame, store: str) -> DataFrame:
    """The delivery form: message_id store/address#revision; content type and digest are null without a payload."""
    has = F.col("has_value")
    return records.select(
        F.concat(F.lit(f"{store}/"), "address", F.lit("#"), F.col("revision").cast("string")).alias("message_id"),
        "address", "revision", "global_position", "operation", "status",
        F.when(has, F.coalesce(F.col("content_type") if "content_type" in records.columns else F.lit(None).cast("string"), F.lit("application/json"))).alias("content_type"),
        F.when(has, F.sha2(F.col("value").cast("decimal(20,4)").cast("string"), 256)).alias("fingerprint"),
    )
