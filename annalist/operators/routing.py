"""Which states a signal, a start or the maintenance loop reaches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import DEFAULT_PARTITION, is_descendant


def signal_targets(signals: DataFrame, states: DataFrame, handles: DataFrame) -> DataFrame:
    """(signal_id, path, partition) that signals (signal_id, name, partition or null, scope) refresh.

    states (path, partitioned, signals): names match in any case. An explicit partition reaches that handle of a
    partitioned state; a singleton ignores signals of another partition than the default. Without one, all active
    handles (path, partition) of a partitioned state are reached, or a singleton's default. Spark broadcasts the
    declarations where they are small at run time.
    """
    names = states.select("path", "partitioned", F.explode(F.array_distinct(F.transform("signals", lambda s: F.lower(s)))).alias("wanted"))
    hit = signals.join(names, F.lower("name") == F.col("wanted")).where((F.col("scope") == "") | is_descendant(F.col("scope"), F.col("path")))
    explicit = hit.where(F.col("partition").isNotNull() & (F.col("partitioned") | (F.col("partition") == DEFAULT_PARTITION))).select("signal_id", "path", "partition")
    single = hit.where(F.col("partition").isNull() & ~F.col("partitioned")).select("signal_id", "path", F.lit(DEFAULT_PARTITION).alias("partition"))
    active = hit.where(F.col("partition").isNull() & F.col("partitioned")).select("signal_id", "path").join(handles, "path")
    return explicit.unionByName(single).unionByName(active.select("signal_id", "path", "partition")).distinct()


def warm_targets(states: DataFrame) -> DataFrame:
    """(path, partition) loaded at start: the warm partitions of a state, or its default."""
    some = F.when(F.size("warm_partitions") > 0, F.array_sort(F.array_distinct("warm_partitions"))).otherwise(F.array(F.lit(DEFAULT_PARTITION)))
    return states.where("warm_on_start").select("path", F.explode(some).alias("partition"))


def maintenance_due(heads: DataFrame, now: Column, interval: Column) -> DataFrame:
    """Heads whose interval is over, inclusive; a state that never occurred is due."""
    return heads.where(F.col("occurred_at").isNull() | (F.col("occurred_at") + interval <= now))


def container_parents(paths: DataFrame, containers: DataFrame) -> DataFrame:
    """The nearest container above each path: all its prefixes are looked up by equality, and the longest wins."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    prefixes = paths.withColumn("__above", F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>")))
    found = prefixes.select("path", F.explode("__above").alias("parent")).join(containers.select(F.col("path").alias("parent")).distinct(), "parent")
    best = found.groupBy("path").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return paths.join(best, "path", "left").withColumn("parent", F.coalesce("parent", F.lit("")))


def duplicate_declarations(rows: DataFrame) -> DataFrame:
    """(kind, name) declared more than once, in any case."""
    return rows.groupBy("kind", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("declared")).where("declared > 1")
