"""Roll-ups of load reports, failures and telemetry."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

#: Upper ends of a histogram of durations, in milliseconds; the last bucket is open.
BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def anchored_rate_limit(rows: DataFrame, key: str, second: str, order: str, window: int = 60, most: int = 16) -> DataFrame:
    """reported or suppressed: a fixed window starts at a failure and holds for window seconds; the next failure after it
    starts another. Each holds at most `most` reports. An ordered fold per key."""

    def step(state, at):
        start, n = state
        if start is None or at - start >= window:
            start, n = at, 0
        return (start, min(n + 1, most)), (n < most,)

    out = ordered.fold(rows, key, [order, second], [second], "reported boolean", lambda: (None, 0), step)
    return out.select(key, order, "reported")


def newest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The newest n rows of all (a bounded log): a distributed top-n."""
    return rows.orderBy(*order).limit(n)


def latest_reports(reports: DataFrame, most: int = 64) -> DataFrame:
    """The last completed load of each address, and of those the newest `most`."""
    last = reports.groupBy("address").agg(F.max_by(F.struct("source", "elapsed", "completed"), F.struct("completed", "source")).alias("r")).select("address", "r.*")
    return newest(last, most, F.col("completed").desc(), F.col("address").desc())


def health(reports: DataFrame) -> DataFrame:
    """One row: loads, incomplete loads, total and slowest elapsed with its source, verdict."""
    out = reports.agg(F.count(F.lit(1)).alias("loads"), F.sum(F.when(F.col("complete"), 0).otherwise(1)).cast("long").alias("incomplete"), F.sum("elapsed").cast("long").alias("elapsed"), F.max(F.struct("elapsed", "source"))["source"].alias("slowest_source"), F.max("elapsed").cast("long").alias("slowest"))
    verdict = F.when(F.col("loads") == 0, "unknown").when(F.col("incomplete") == 0, "healthy").when(F.col("incomplete") < F.col("loads"), "degraded").otherwise("unhealthy")
    return out.withColumn("verdict", verdict)


def telemetry(records: DataFrame, tags: list[str], measure: str) -> DataFrame:
    """Counters and sums by tags; partial aggregates before the shuffle."""
    return records.groupBy(*tags).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).cast("long").alias("total"), F.min(measure).cast("long").alias("least"), F.max(measure).cast("long").alias("most"))


def histogram(records: DataFrame, tags: list[str], measure: str, bounds=BOUNDS) -> DataFrame:
    """Records by tags and bucket of a measure: bucket i holds values above bounds[i-1] and up to bounds[i] (upper; null: open)."""
    ends = F.array(*map(F.lit, bounds))
    bucket = F.size(F.filter(ends, lambda b: b < F.col(measure))).alias("bucket")
    out = records.where(F.col(measure).isNotNull()).groupBy(*tags, bucket).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("upper", F.try_element_at(ends, F.col("bucket") + 1).cast("long"))
