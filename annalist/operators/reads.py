"""Reads: latest, history, change feed, catalogue, capture, replication lag, tiers. All take explicit times and positions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_latest(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The record of the largest revision of each address; maxima are partial before the shuffle."""
    columns = columns or [c for c in records.columns if c != "address"]
    top = records.groupBy("address").agg(F.max_by(F.struct(*columns), "revision").alias("r"))
    return top.select("address", "r.*")


def read_history(records: DataFrame, take: int | None = 100, before: Column | int | None = None, since: Column | None = None, newest_first: bool = True) -> DataFrame:
    """Per address: revision < before, occurred_at >= since, in order of revision, then at most take records."""
    if take is not None and take <= 0:
        raise ValueError("take must be positive")
    rows = records
    if before is not None:
        rows = rows.where(F.col("revision") < before)
    if since is not None:
        rows = rows.where(F.col("occurred_at") >= since)
    if take is None:
        return rows
    order = F.col("revision").desc() if newest_first else F.col("revision").asc()
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("address").orderBy(order))).where(F.col("__n") <= take).drop("__n")


def history_of(records: DataFrame, address: str, take: int = 100, most: int = 1000, newest_first: bool = True) -> DataFrame:
    """One address's history as an endpoint serves it: take is clamped to 1..most."""
    order = F.col("revision").desc() if newest_first else F.col("revision").asc()
    return records.where(F.col("address") == address).orderBy(order).limit(max(1, min(take, most)))


def read_feed(records: DataFrame, cursor: int = 0, take: int | None = None) -> DataFrame:
    """Records after a position, by position, then address and revision; the cursor is a pushed-down range filter."""
    if take is not None and take <= 0:
        raise ValueError("take must be positive")
    rows = records.where(F.col("global_position") > cursor)
    order = [c for c in ("global_position", "address", "revision") if c in records.columns]
    return rows.orderBy(*order) if take is None else rows.orderBy(*order).limit(take)


def span_offsets(counts: DataFrame, many: int = 4096) -> DataFrame:
    """(__span, __before) of counts (__span, __c): the rows of all spans before. On two levels: only totals of many spans
    meet in one task, 3,700 rows for 10^12 positions. Spark broadcasts the result where it is small at run time."""
    level = counts.withColumn("__top", F.floor(F.col("__span") / many))
    above = Window.orderBy("__top").rowsBetween(Window.unboundedPreceding, -1)
    tops = level.groupBy("__top").agg(F.sum("__c").alias("__t")).select("__top", F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__a"))
    within = Window.partitionBy("__top").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = level.withColumn("__b", F.coalesce(F.sum("__c").over(within), F.lit(0)))
    return spans.join(tops, "__top").select("__span", (F.col("__a") + F.col("__b")).alias("__before"))


def feed_pages(records: DataFrame, take: int, cursor: int = 0, span: int = 1 << 16) -> DataFrame:
    """All pages of a drain: page numbers from 0; records of one position stay in one page.

    Positions are ranked without a global window: counts per span of positions give every span its offset, and ranks
    are counted within a span.
    """
    rows = records.where(F.col("global_position") > cursor).withColumn("__span", F.floor(F.col("global_position") / span))
    offsets = span_offsets(rows.groupBy("__span").agg(F.count(F.lit(1)).alias("__c")))
    # rank(): the page of a position is that of its first record, so no page border falls inside a collision
    rank = F.rank().over(Window.partitionBy("__span").orderBy("global_position"))
    ranked = rows.withColumn("__rank", rank).join(offsets, "__span")
    return ranked.withColumn("page", F.floor((F.col("__before") + F.col("__rank") - 1) / take)).drop("__span", "__rank", "__before")


def partition_catalog(records: DataFrame) -> DataFrame:
    """Every address with the position of its newest record."""
    return records.groupBy("address").agg(F.max_by("global_position", "revision").alias("last_position"), F.max("revision").alias("last_revision"))


def replication_lag(authority: DataFrame, replica: DataFrame) -> DataFrame:
    """One row: positions, partitions behind (missing or lower), gap and caught_up. Catalogues are small next to records."""
    a, r = partition_catalog(authority).alias("a"), partition_catalog(replica).alias("r")
    both = a.join(r, "address", "left")
    behind = F.col("r.last_position").isNull() | (F.col("r.last_position") < F.col("a.last_position"))
    out = both.agg(F.coalesce(F.max("a.last_position"), F.lit(0)).alias("authority_position"), F.coalesce(F.max("r.last_position"), F.lit(0)).alias("replica_position"), F.sum(F.when(behind, 1).otherwise(0)).cast("long").alias("partitions_behind"))
    out = out.withColumn("partitions_behind", F.coalesce("partitions_behind", F.lit(0)))
    out = out.withColumn("gap", F.greatest(F.lit(0), F.col("authority_position") - F.col("replica_position")))
    return out.withColumn("caught_up", (F.col("partitions_behind") == 0) & (F.col("gap") == 0))


def tiered_latest(hot: DataFrame, cold: DataFrame, prefer_hot: bool = True) -> DataFrame:
    """The latest record of each address over two tiers, and the tier it came from; repair: the hot tier must import it."""
    h, c = read_latest(hot).select("address", F.struct("*").alias("h")), read_latest(cold).select("address", F.struct("*").alias("c"))
    both = h.join(c, "address", "full_outer")
    use_hot = F.col("h").isNotNull() & (F.lit(prefer_hot) | F.col("c").isNull())
    picked = F.when(use_hot, F.col("h")).otherwise(F.col("c"))
    repair = F.col("c").isNotNull() & (F.col("h").isNull() | (~F.lit(prefer_hot) & (F.col("h.revision") < F.col("c.revision"))))
    return both.select(picked.alias("p"), F.when(use_hot, "hot").otherwise("cold").alias("tier"), repair.alias("repair")).select("p.*", "tier", "repair")


def capture(refs: DataFrame, records: DataFrame, position: int | None = None) -> DataFrame:
    """Every distinct referenced address with its latest record at or before a position; absent ones have revision 0."""
    rows = records if position is None else records.where(F.col("global_position") <= position)
    found = read_latest(rows.join(refs.select("address").distinct(), "address", "left_semi"))
    out = refs.select("address").distinct().join(found, "address", "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("Absent")), "revision": F.coalesce("revision", F.lit(0).cast("long")), "global_position": F.coalesce("global_position", F.lit(0).cast("long")), "has_value": F.coalesce("has_value", F.lit(False))})


def capture_position(captured: DataFrame) -> DataFrame:
    return captured.agg(F.coalesce(F.max("global_position"), F.lit(0)).alias("capture_position"), F.count(F.lit(1)).alias("states"), F.sum(F.when(F.col("status") == "Absent", 1).otherwise(0)).cast("long").alias("absent"))


def change_pairs(records: DataFrame, columns: list[str]) -> DataFrame:
    """Each record with the columns of the one before it in its address, as previous_<column>."""
    w = Window.partitionBy("address").orderBy("revision")
    return records.select("*", *(F.lag(c).over(w).alias(f"previous_{c}") for c in columns))


def observe_buffer(records: DataFrame, capacity: int = 64) -> DataFrame:
    """What a slow observer with a bounded, drop-oldest buffer still holds of each address."""
    return read_history(records, capacity)
