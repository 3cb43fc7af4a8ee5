"""Loading a state from several facets: ordered left joins on the partition, and failure semantics."""

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import source_status_key


@dataclass(frozen=True)
class Source:
    """A facet: rows keyed by key with one struct column value; a key without a row failed. apply(state, value) -> state."""

    name: str
    rows: DataFrame
    apply: Callable[[Column, Column], Column]


def fetch(base: DataFrame, key: str, sources: list[Source]) -> DataFrame:
    """base with one struct column per source, null where it failed; order of fetching does not matter."""
    out = base
    for s in sources:
        out = out.join(s.rows.select(F.col(key), F.col("value").alias(f"facet_{s.name}")), key, "left")
    return out


def compose(base: DataFrame, key: str, state: str, sources: list[Source], best_effort: bool = False, initial: Column | None = None) -> DataFrame:
    """The state after applying all facets, in declared order, onto the current one (or initial where there is none).

    status: Ready or Faulted; completeness: complete, partial, initial-fallback, or null when faulted; faulted: names of
    failed sources, sorted; error_code. With require-all any failure faults; with best effort the facets that came
    are applied, and only when none came and there is no fresh initial value the load faults.
    """
    rows = fetch(base, key, sources)
    current = F.col(state)
    seeded = current.isNull() & (initial.isNotNull() if initial is not None else F.lit(False))
    work = F.coalesce(current, initial) if initial is not None else current
    for s in sources:
        got = F.col(f"facet_{s.name}")
        work = F.when(got.isNotNull(), s.apply(work, got)).otherwise(work)
    failed = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"facet_{s.name}").isNull(), F.lit(s.name)) for s in sources))))
    n = F.size("faulted")
    rows = rows.withColumn("faulted", failed).withColumn("__work", work).withColumn("__seeded", seeded)
    fault = n > 0 if not best_effort else (n == len(sources)) & ~F.col("__seeded")
    completeness = F.when(n == 0, "complete").when(n < len(sources), "partial").otherwise("initial-fallback")
    error = F.when(fault, "loader-failed").when(n > 0, "partial-load")
    out = rows.withColumns({"__fault": fault})
    return out.select(
        *(c for c in base.columns if c != state),
        F.when(F.col("__fault"), current).otherwise(F.col("__work")).alias(state),
        F.when(F.col("__fault"), "Faulted").otherwise("Ready").alias("status"),
        F.when(~F.col("__fault"), completeness).alias("completeness"),
        error.alias("error_code"),
        F.array_join("faulted", ", ").alias("faulted"),
        F.size("faulted").alias("n_faulted"),
    )


def load_metadata(names: list[str], faulted: Column) -> Column:
    """source.<name>.status of each source, by its sanitised name."""
    pairs = [x for n in names for x in (F.concat(F.lit("source."), source_status_key(F.lit(n)), F.lit(".status")), F.when(F.array_contains(F.split(faulted, ", "), n), "faulted").otherwise("ready"))]
    return F.create_map(*pairs)


def merge_metadata(options: Column, loaded: Column) -> Column:
    """Load metadata over option metadata; keys are compared in lower case, the later one wins."""
    lower = lambda m: F.transform_keys(m, lambda k, _: F.lower(k))
    a, b = lower(options), lower(loaded)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def refresh_requests(requests: DataFrame) -> DataFrame:
    """Requests (address, batch, source) coalesced: one refresh of an address in a batch, by its first request."""
    return requests.groupBy("address", "batch").agg(F.min_by("source", "seq").alias("source"), F.count(F.lit(1)).alias("coalesced"))
