"""Ledger views over the tables of a data directory: the events as a ledger, its replica, commands, imports, facets."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.freshness import ts

AS_OF = "2024-01-31 00:00:00"
HOUR = "interval 1 hour"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operation():
    """The ledger operation of an event."""
    kind = F.col("event_type")
    return F.when(kind == "view", "Refreshed").when(kind == "click", "Transitioned").when(kind == "purchase", "Set").when(kind == "signup", "Cleared").otherwise(F.when(F.col("event_id") % 2 == 0, "Faulted").otherwise("Invalidated"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of app::users/activity::<user>: one exchange by address, then windows over its history."""
    e = table(spark, sf_dir, "events")
    history = Window.partitionBy("partition").orderBy("event_id")
    so_far = history.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = e.select("event_id", "user_id", F.col("ts").alias("occurred_at"), F.col("value").alias("given"), "props", operation().alias("operation"), F.col("user_id").cast("string").alias("partition"))
    ready = F.col("operation").isin("Refreshed", "Transitioned", "Set")
    rows = rows.withColumn("revision", F.row_number().over(history).cast("long")).withColumn("epoch", F.sum(F.when(F.col("operation") == "Cleared", 1).otherwise(0)).over(so_far))
    size = F.length("props") * F.ceil("given").cast("int")
    in_epoch = Window.partitionBy("partition", "epoch").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(F.when(ready, F.struct(F.col("given").alias("v"), size.alias("b"))), ignorenulls=True)
    served = F.when(ready, F.expr(f"occurred_at + 30 * {HOUR}"))
    rows = rows.withColumn("last", carried.over(in_epoch)).withColumn("last_serve", F.last(served, ignorenulls=True).over(so_far))
    held = F.when(F.col("operation") != "Cleared", F.col("last"))
    return rows.select(
        F.lit("app").alias("root"), F.lit("users/activity").alias("path"), "partition", F.concat(F.lit("app::users/activity::"), "partition").alias("address"),
        (F.col("event_id") + 1).alias("global_position"), "revision", "occurred_at", "operation", F.when(ready, "Ready").otherwise(F.col("operation")).alias("status"),
        held["v"].alias("value"), F.coalesce(held["b"], F.lit(0)).cast("long").alias("payload_bytes"), held["v"].isNotNull().alias("has_value"),
        F.when(ready, F.expr(f"occurred_at + 6 * {HOUR}")).otherwise(F.col("occurred_at")).alias("fresh_until"),
        F.when(ready, served).otherwise(F.greatest("occurred_at", "last_serve")).alias("serve_until"),
        F.when(F.col("event_id") % 2 == 0, 1).otherwise(2).alias("schema_version"),
        F.when(F.col("operation").isin("Refreshed", "Faulted"), "loader").when(F.col("operation") == "Transitioned", "interaction").otherwise("application").alias("source"),
        F.lit("double").alias("value_type"), "props", "user_id", "event_id",
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow columns of the ledger that need no window: enough for reads by position."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("app::users/activity::"), F.col("user_id").cast("string")).alias("address"), (F.col("event_id") + 1).alias("global_position"), F.col("ts").alias("occurred_at"), "event_type", "user_id", "event_id", "value")


def replica(records: DataFrame, high: int) -> DataFrame:
    """A replica that lags: the first 0.8 of all positions, and none of every seventh user."""
    return records.where((F.col("global_position") <= F.floor(F.lit(high) * 0.8)) & (F.col("user_id") % 7 != 0))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed writes: condition Absent, AtRevision or Any by event."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 4 == 1, "Absent").when(F.col("event_id") % 4 == 2, "AtRevision").otherwise("Any")
    return e.select(F.concat(F.lit("app::users/activity::"), F.col("user_id").cast("string")).alias("address"), F.col("event_id").alias("seq"), kind.alias("condition"), F.when(kind == "AtRevision", 1 + F.col("event_id") % 7).cast("long").alias("expected"), "value")


def imports(records: DataFrame) -> DataFrame:
    """Late exact imports of early revisions, at far positions."""
    return records.where((F.col("user_id") % 5 == 0) & (F.col("revision") <= 3)).withColumn("operation", F.lit("Imported")).withColumn("global_position", 1_000_000 + F.col("event_id"))


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of app::customers/orders::<customer>."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.concat(F.lit("app::customers/orders::"), F.col("o_custkey").cast("string")).alias("address"), F.row_number().over(w).cast("long").alias("revision"), F.col("o_orderkey").alias("global_position"), F.col("o_orderdate").alias("occurred_at"), F.lit("Set").alias("operation"), F.floor("o_totalprice").cast("long").alias("payload_bytes"))


def as_of():
    return ts(AS_OF)
