"""Snapshots of records at an explicit time: derived status, freshness, read decisions. Never the wall clock."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREVER = "9999-12-31 23:59:59.999999"


def ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def is_fresh(as_of: Column, has_value: Column | None = None, fresh_until: Column | None = None) -> Column:
    """Holds a value and observed at or before fresh_until (inclusive); the stored status does not matter."""
    has = F.col("has_value") if has_value is None else has_value
    until = F.col("fresh_until") if fresh_until is None else fresh_until
    return F.coalesce(has & (as_of <= until), F.lit(False))


def derived_status(as_of: Column) -> Column:
    """Ready and Stale follow the time, both ways; the other statuses never change by time."""
    timed = F.col("status").isin("Ready", "Stale") & F.col("has_value")
    return F.when(timed & (as_of > F.col("fresh_until")), "Stale").when(timed, "Ready").otherwise(F.col("status"))


def snapshot(records: DataFrame, as_of: Column) -> DataFrame:
    """Records as observed at as_of: status, is_fresh, is_stale and can_serve (advisory) added or replaced."""
    fresh = is_fresh(as_of)
    return records.select(
        *(c for c in records.columns if c not in ("status", "is_fresh", "is_stale", "can_serve")),
        derived_status(as_of).alias("status"),
        fresh.alias("is_fresh"),
        (F.col("has_value") & ~fresh).alias("is_stale"),
        F.coalesce(F.col("has_value") & (as_of <= F.col("serve_until")), F.lit(False)).alias("can_serve"),
    )


def reobserve(records: DataFrame, as_of: Column) -> DataFrame:
    """A snapshot observed again later: only Ready and Stale are recomputed."""
    return snapshot(records, as_of)


MODES = ("Cached", "Current", "RefreshIfStale", "Fresh")


def needs_refresh(mode: Column, status: Column, fresh: Column, on_first_read: Column, when_stale: Column) -> Column:
    """Whether a read of a snapshot must load first, by read mode and refresh policy."""
    absent = status == "Absent"
    old = status.isin("Stale", "Invalidated", "Faulted")
    return (
        F.when(mode == "Cached", F.lit(False))
        .when(mode == "Fresh", ~fresh | status.isin("Invalidated", "Faulted"))
        .when(mode == "RefreshIfStale", absent | (status == "Cleared") | old)
        .otherwise((absent & on_first_read) | (old & when_stale))
    )


def read_decisions(snapshots: DataFrame, mode: str = "mode", on_first_read: Column | None = None, when_stale: Column | None = None, background: Column | None = None, allow_last_known: Column | None = None) -> DataFrame:
    """needs_refresh, in_background (a Current read of a held value may refresh later) and served, per snapshot and mode."""
    yes = F.lit(True)
    m, fresh, status = F.col(mode), F.col("is_fresh"), F.col("status")
    need = needs_refresh(m, status, fresh, on_first_read if on_first_read is not None else yes, when_stale if when_stale is not None else yes)
    later = need & (m == "Current") & F.col("has_value") & (background if background is not None else yes)
    last_known = (allow_last_known if allow_last_known is not None else F.lit(False)) & (status == "Faulted") & F.col("has_value")
    served = F.when(m == "Fresh", (fresh & (status == "Ready")) | last_known).otherwise(F.col("has_value"))
    return snapshots.select("*", need.alias("needs_refresh"), later.alias("in_background"), served.alias("served"))


def required_value(value: Column, address: Column) -> Column:
    """The value, or an error that names the address."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("no usable value at "), address)))


@dataclass(frozen=True)
class Codec:
    """How values become payloads and come back: encode(value) and decode(payload, schema) of Columns.

    The name is kept with every payload; the type of its bytes is unknown unless it is said.
    """

    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column, str], Column]
    content_type: str = "application/octet-stream"

    def envelope(self, value: Column) -> Column:
        return F.struct(self.encode(value).alias("payload"), F.lit(self.name).alias("serializer"), F.lit(self.content_type).alias("content_type"))


JSON = Codec("json", F.to_json, F.from_json, "application/json")


def decode(payload: Column, version: Column, current: int, schemas: dict[int, str], migrations: dict, codec: Codec = JSON) -> Column:
    """A payload as a value of the current schema; another version goes through its own migration, no chains."""
    out = F.when(version == current, codec.decode(payload, schemas[current]))
    for v, migrate in migrations.items():
        out = out.when(version == v, migrate(codec.decode(payload, schemas[v])))
    return out.when(version.isNotNull(), F.raise_error(F.concat(F.lit("no migration from version "), version.cast("string"))))
