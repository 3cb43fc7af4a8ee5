"""At-least-once delivery of the change feed."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflicts_and_new(incoming: DataFrame, delivered: DataFrame) -> DataFrame:
    """Each incoming message (global_position, message_id): new, duplicate (same id) or conflict (another id at its position)."""
    seen = delivered.select("global_position", F.col("message_id").alias("__seen")).distinct()
    both = incoming.join(seen, "global_position", "left")
    outcome = F.when(F.col("__seen").isNull(), "new").when(F.col("__seen") == F.col("message_id"), "duplicate").otherwise("conflict")
    return both.withColumn("outcome", outcome).drop("__seen")


def advance_cursor(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """Cursors (consumer, position) only move forward."""
    return stored.unionByName(proposed).groupBy("consumer").agg(F.max("position").alias("position"))


def batches(paged: DataFrame, size: int) -> DataFrame:
    """Feed pages as delivery batches: messages, cursor before and after."""
    out = paged.groupBy("page").agg(F.count(F.lit(1)).alias("messages"), F.min("global_position").alias("first_position"), F.max("global_position").alias("cursor_after"))
    return out.withColumn("full", F.col("messages") >= size)


def backoff(attempt: Column, least: int, most: int) -> Column:
    """least * 2**attempt, at most `most` (the exponent is bounded before the power)."""
    return F.least(F.lit(most).cast("long"), (F.lit(least) * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)))).cast("long"))


def poison(attempts: Column, most: int) -> Column:
    """Whether a batch that failed so often in a row is skipped as a whole."""
    return attempts >= most
