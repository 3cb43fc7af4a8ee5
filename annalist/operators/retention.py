"""Retention: four filters per address, one after another; the head always stays.

Age and tombstones are filters against the head's revision, the count of revisions is a rank among survivors, and the
byte budget is a greedy fold, newest first, that skips records that do not fit and goes on.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


@dataclass(frozen=True)
class Policy:
    age: str | None = None  # an interval, such as "interval 10 days"
    keep_tombstones: bool = True
    max_revisions: int | None = None
    max_bytes: int | None = None


def prune(records: DataFrame, policy: Policy, now: Column | None = None) -> DataFrame:
    """The records that stay."""
    columns = records.columns
    head = Window.partitionBy("address")
    rows = records.withColumn("__head", F.max("revision").over(head))
    is_head = F.col("revision") == F.col("__head")
    if policy.age is not None:
        rows = rows.where((F.col("occurred_at") >= now - F.expr(policy.age)) | is_head)
    if not policy.keep_tombstones:
        rows = rows.where((F.col("operation") != "Cleared") | is_head)
    if policy.max_revisions is not None:
        rank = F.row_number().over(Window.partitionBy("address").orderBy(F.col("revision").desc()))
        rows = rows.withColumn("__n", rank).where(F.col("__n") <= policy.max_revisions)
    if policy.max_bytes is not None:
        rows = _within_bytes(rows.select(*columns), policy.max_bytes)
    return rows.select(*columns)


def _within_bytes(rows: DataFrame, most: int) -> DataFrame:
    """Greedy, newest first: the first always fits; a later one that does not fit is skipped."""

    def step(total, size):
        if total is None or total + size <= most:
            return (total or 0) + size, (True,)
        return total, (False,)

    return ordered.fold(rows, "address", [F.col("revision").desc()], ["payload_bytes"], "__fits boolean", lambda: None, step).where("__fits").drop("__fits")
