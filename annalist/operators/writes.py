"""Ordered folds of commands per address: one exchange by address, and a pass over its ordered commands or a JVM aggregate."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .reads import span_offsets


def conditional_append(commands: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Commands (address, seq, condition, expected) in order of seq: appended with the next revision, or conflict.

    Absent needs no head, AtRevision the head's revision, Any nothing; a conflict changes nothing and carries the
    current revision. heads (address, revision) gives the state before the first command.
    """
    rows = commands.select("address", F.lit(1).alias("kind"), "seq", "condition", "expected")
    if heads is not None:  # a head is read before the commands of its address
        rows = rows.unionByName(heads.select("address", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("condition"), F.col("revision").alias("expected")))

    def step(revision, kind, condition, expected):
        if kind == 0:
            return expected, (None, None)
        if condition == "Absent" and revision or condition == "AtRevision" and expected != revision:
            return revision, ("conflict", revision)
        return revision + 1, ("appended", revision + 1)

    done = ordered.fold(rows, "address", ["kind", "seq", "condition", "expected"], ["kind", "condition", "expected"], "outcome string, revision long", int, step)
    return done.where("kind = 1").select("address", "seq", "outcome", "revision")


def revision_numbering(rows: DataFrame, order: str) -> DataFrame:
    """The next revision of each record of an address, from 1."""
    return rows.withColumn("revision", F.row_number().over(Window.partitionBy("address").orderBy(order)).cast("long"))


def last_known_value(rows: DataFrame, ready: Column, cleared: Column, value: str, order: str) -> DataFrame:
    """last_known: the last ready value, carried through markers and faults, dropped by a clear."""
    w = Window.partitionBy("address").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epoch = rows.withColumn("__epoch", F.sum(F.when(cleared, 1).otherwise(0)).over(w))
    e = Window.partitionBy("address", "__epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return epoch.withColumn("last_known", F.when(~cleared, F.last(F.when(ready, F.col(value)), ignorenulls=True).over(e))).drop("__epoch")


def reduce_commands(rows: DataFrame, order: list[str], initial: Column, step, finish=None) -> DataFrame:
    """address and state: commands folded in order by a reducer of Columns, step(state, command)."""
    cs = rows.groupBy("address").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in rows.columns if c not in (*order, "address"))))).alias("cs"))
    args = [step] if finish is None else [step, finish]
    return cs.select("address", F.aggregate("cs", initial, *args).alias("state"))


def dispatch(rows: DataFrame, order: list[str], initial: Column, reducer, requirements: list, invariant) -> DataFrame:
    """address, state, accepted, rejected and broken: commands that meet all requirements and keep the invariant are reduced.

    requirements: functions (state, command) -> reason or null, all evaluated; a rejected command changes nothing.
    """

    def step(acc, c):
        state = acc["state"]
        refused = F.greatest(F.lit(0), *(F.when(r(state, c).isNotNull(), 1).otherwise(0) for r in requirements), F.lit(0)) == 1
        new = reducer(state, c)
        broken = ~refused & ~F.coalesce(invariant(new), F.lit(False))
        keep = refused | broken
        return F.struct(F.when(keep, state).otherwise(new).alias("state"), (acc["accepted"] + F.when(keep, 0).otherwise(1)).cast("long").alias("accepted"), (acc["rejected"] + F.when(refused, 1).otherwise(0)).cast("long").alias("rejected"), (acc["broken"] + F.when(broken, 1).otherwise(0)).cast("long").alias("broken"))

    zero = F.lit(0).cast("long")
    start = F.struct(initial.alias("state"), zero.alias("accepted"), zero.alias("rejected"), zero.alias("broken"))
    return reduce_commands(rows, order, start, step).select("address", "state.*")


def suppress_equivalent(rows: DataFrame, value: str, order: str, equal=lambda a, b: a.eqNullSafe(b)) -> DataFrame:
    """Writes that differ from the value before them (null-safe, or by a comparer of two Columns); status is ignored, and
    the first write always stays."""
    w = Window.partitionBy("address").orderBy(order)
    n = F.row_number().over(w)
    return rows.select("*", n.alias("__n"), F.lag(value).over(w).alias("__before")).where((F.col("__n") == 1) | ~F.coalesce(equal(F.col(value), F.col("__before")), F.lit(False))).drop("__n", "__before")


def fault_record(rows: DataFrame, keep_last_known: bool) -> DataFrame:
    """Faults of failed loads: the last known value is kept by policy, and only if there is one."""
    keep = F.lit(keep_last_known) & F.col("last_known").isNotNull()
    return rows.withColumns({"value": F.when(keep, F.col("last_known")), "has_value": keep, "error_code": F.lit("loader-failed"), "transient": F.lit(True)})


def import_exact(records: DataFrame, imported: DataFrame, columns: list[str]) -> DataFrame:
    """Exact import: an imported record replaces the one of its address and revision; of several, the last position wins."""
    own = records.select(*columns, F.lit(0).alias("__round"))
    new = imported.select(*columns, F.lit(1).alias("__round"))
    rest = [c for c in columns if c not in ("address", "revision")]
    both = own.unionByName(new).groupBy("address", "revision").agg(F.max_by(F.struct(*rest, "__round"), F.struct("__round", "global_position")).alias("r"))
    return both.select("address", "revision", *(F.col(f"r.{c}") for c in rest), (F.col("r.__round") == 1).alias("imported"))


def allocate_positions(rows: DataFrame, order: str, high: int, span: int = 1 << 16) -> DataFrame:
    """Dense positions after a high-water mark, in order of a numeric column, without a global window over the rows."""
    spans = rows.withColumn("__span", F.floor(F.col(order) / span))
    offsets = span_offsets(spans.groupBy("__span").agg(F.count(F.lit(1)).alias("__c")))
    rank = F.row_number().over(Window.partitionBy("__span").orderBy(order))
    return spans.withColumn("__rank", rank).join(offsets, "__span").withColumn("position", F.lit(high) + F.col("__before") + F.col("__rank")).drop("__span", "__rank", "__before")


def late_imports(imported: DataFrame, cursor: int) -> DataFrame:
    """Imports at or below a consumer's cursor, which the feed will not deliver again."""
    return imported.withColumn("late", F.col("global_position") <= cursor)
