"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size within their source. Each size first gives its proportional share of the source's
target, rounded along the order of sizes, so that the mix follows the counts. What rounding left, with some of the
shares given back, is a budget that a bounded knapsack over (size, takes left) fills to the nearest reachable sum, on
either side; more is given back, up to everything where the program's budget allows, until the target is met. No
document is taken more than `most` times. Which documents of a size are taken once more follows a seeded hash.

Targets are found with aggregates over a table of the sources; only a few numbers of each round reach the driver.

Rows: any column may be null (a null text has size 0, a null source is a source of its own, after all others).
Documents without words take 0 words. Repeated rows are separate documents. An empty table gives no rows. Other columns
of the input are ignored. A source that has no words has target 0.
"""

from fractions import Fraction
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Words, arrow_map, as_key, materialize, mix, pieces, text_buffers

WEIGHTS = (5, 2, 1)  # fixed values of the contract
SHARE, MOST = Fraction(3, 2), 2
#: Largest budget, in words, that the dynamic program is given for one source; the proportional shares take the rest.
DP_BUDGET = 1 << 16
#: A plan, or a table of sources, of more rows is joined by shuffle instead of broadcast (a row has under 100 bytes).
BROADCAST_ROWS = 100_000


def mix_key(id_col: str, source_col: str, text_col: str):
    """Names a row by its id, source and text; equal rows share it."""
    return F.xxhash64(as_key(id_col), as_key(source_col), as_key(text_col))


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc_id, source, key, size): the words of each text."""

    def count(batches):
        for p in pieces(batches, 3):
            size = Words(*text_buffers(p.column(3))).counts()
            yield pa.RecordBatch.from_arrays([*p.columns[:3], pa.array(size, pa.int64())], names=["doc_id", "source", "key", "size"])

    kinds = dict(docs.dtypes)
    return arrow_map(docs.select(F.col(id_col), F.col(source_col), mix_key(id_col, source_col, text_col), F.col(text_col)), count, f"doc_id {kinds[id_col]}, source {kinds[source_col]}, key long, size long")


def targets(totals: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """totals (skey, source_size) -> also target (double) and goal (the nearest whole number).

    Shares go by the weights of the sources' order by code point, null last; what a source would get above most times
    its size is shared anew by weight until none is above. Exact fractions: comparisons are in decimals.
    """
    # Places: sorted partitions, whose row counts (one a partition) give each partition its offset.
    ordered = totals.orderBy(F.col("skey") == "n", "skey").withColumn("__at", F.monotonically_increasing_id())
    ordered = materialize(ordered, "sources")
    part = F.shiftright("__at", 33)
    before, offsets = 0, []
    for r in ordered.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets += [F.lit(r["p"]), F.lit(before)]
        before += r["count"]
    if not before:
        return ordered.select("skey", "source_size", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("goal"))
    place = F.create_map(*offsets)[part] + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = ordered.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1))
    most, whole = Fraction(most), ordered.agg(F.sum("source_size")).first()[0]
    budget, weight, unit = Fraction(share) * whole, rows.agg(F.sum("__w")).first()[0], Fraction(0)
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    full = F.lit(False)
    while weight:
        unit = budget / weight
        size = F.col("source_size").cast("decimal(38,0)") * big(most.numerator * unit.denominator)
        full = F.col("__w").cast("decimal(38,0)") * big(unit.numerator * most.denominator) > size
        left = rows.agg(F.sum(F.when(~full, F.col("__w"))).alias("w"), F.sum(F.when(full, F.col("source_size"))).alias("s")).first()
        if (left.w or 0) == weight:
            break
        budget, weight = Fraction(share) * whole - most * (left.s or 0), left.w or 0
    by_weight = {w: unit * w for w in set(weights)}
    pick = lambda f: F.element_at(F.create_map(*(F.lit(x) for w in by_weight for x in (w, f(by_weight[w])))), F.col("__w"))
    limit = F.col("source_size") * most.numerator / most.denominator
    target = F.when(full, limit).otherwise(pick(float))
    goal = F.when(full, F.floor(limit + 0.5)).otherwise(pick(lambda x: floor(x + Fraction(1, 2))))
    return rows.select("skey", "source_size", target.alias("target"), goal.cast("long").alias("goal"))


def subset(budget: int, sizes: list[int], counts: list[int]) -> dict[int, int]:
    """A bounded subset-sum: how many of each size, so that the sum is the reachable one nearest to budget (the lower of two)."""
    want, steps, reach, limit = 1 << budget, [], 1, (1 << (2 * budget + 1)) - 1
    for size, count in zip(sizes, counts, strict=True):
        left, part = min(count, 2 * budget // size), 1
        while left and not reach & want:
            k = min(part, left)
            steps.append((size, k, reach))
            reach = (reach | reach << (size * k)) & limit
            left, part = left - k, part * 2
        if reach & want:
            break
    below, above = (reach & (2 * want - 1)).bit_length() - 1, reach >> budget
    over = (above & -above).bit_length() - 1 if above else budget + 1
    at, out = below if budget - below <= over else budget + over, {}
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            out[size] = out.get(size, 0) + k
            at -= size * k
    return out


def fitted(goal: int, sizes: np.ndarray, counts: np.ndarray, most: int = MOST, dp_budget: int = DP_BUDGET, seed: int = 17) -> np.ndarray:
    """How many takes each size gives so that their words come to goal; counts documents have a size, each is taken at most `most` times."""
    some = np.flatnonzero(sizes > 0)
    out = np.zeros(len(sizes), np.int64)
    size, most_takes = sizes[some], counts[some] * int(most)
    total = int((size * counts[some]).sum())
    if goal <= 0 or not total:
        return out
    if goal >= int((size * most_takes).sum()):
        out[some] = most_takes
        return out
    cum = [0] + [(2 * c * goal + total) // (2 * total) for c in np.cumsum(counts[some]).tolist()]
    share = np.minimum(np.diff(np.array(cum, np.int64)), most_takes)
    # The order in which sizes give back and fill up is a seeded one, so that neither long nor short texts are preferred.
    order = np.argsort(mix(size.astype(np.uint64) * np.uint64(2) + np.uint64(seed) * np.uint64(1 << 40)), kind="stable")
    best, gap, room = share, goal - int((size * share).sum()), 0
    while gap:
        left, take = goal - int((size * share).sum()), share.copy()
        for i in order.tolist():  # room for the program: give back what it can put together anew
            need = max(room, 0) - left
            if need <= 0 and left >= 0:
                break
            k = min(int(take[i]), -(-need // int(size[i])) if need > 0 else int(take[i]))
            if room and left + k * int(size[i]) > dp_budget:
                k = max(0, min(k, (dp_budget - left) // int(size[i])))
            take[i] -= k
            left += k * int(size[i])
        if left <= dp_budget:
            more = subset(left, size[order].tolist(), (most_takes - take)[order].tolist()) if left > 0 else {}
            take = take + np.array([more.get(int(s), 0) for s in size], np.int64)
        got = goal - int((size * take).sum())
        if abs(got) < abs(gap):
            best, gap = take, got
        if room >= min(dp_budget, goal):
            break
        room = min(max(4 * room, 1024), dp_budget, goal)
    out[some] = best
    return out


def mix_sources(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS, share=SHARE, most=MOST, seed=17, dp_budget=DP_BUDGET) -> DataFrame:
    """One row per document: doc_id, source, key (of id, source and text), size, source_size, target, taken (size times the repeats the mix takes)."""
    sizes = materialize(sized(docs, id_col, source_col, text_col).withColumn("skey", as_key("source")), "sizes")
    hist = sizes.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    goals = materialize(targets(hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "targets")
    goals = F.broadcast(goals) if goals.count() <= BROADCAST_ROWS else goals

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        n = pdf["n"].to_numpy(np.int64)
        takes = fitted(int(pdf["goal"].iloc[0]), pdf["size"].to_numpy(np.int64), n, int(most), dp_budget, seed)
        return pdf.assign(base=takes // n, extra=takes % n)[["skey", "size", "n", "source_size", "base", "target", "extra"]]

    planned = hist.join(goals, "skey").groupBy("skey").applyInPandas(plan, "skey string, size long, n long, source_size long, base long, target double, extra long")
    planned = materialize(planned, "plan")
    stats = planned.agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("extra") > 0, F.col("n"))).alias("most")).first()
    planned = planned if stats.rows > BROADCAST_ROWS else F.broadcast(planned)
    both = sizes.join(planned, ["skey", "size"]).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    # A size may hold a third of all rows: ranks are counted within salts of the hash, from each salt's offset on.
    salts = int(np.ceil(np.sqrt(stats.most or 1)))
    both = both.withColumn("salt", F.pmod("h", F.lit(salts)).cast("int"))
    cut = F.col("extra") > 0
    ranked = both.where(cut)
    before = Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("skey", "size", "salt").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    rank = F.row_number().over(Window.partitionBy("skey", "size", "salt").orderBy("h", "doc_id", "key"))
    ranked = ranked.withColumn("rank", rank).join(offsets, ["skey", "size", "salt"]).withColumn("more", (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")).drop("before", "rank")
    rest = both.where(~cut).withColumn("more", F.lit(0).cast("long"))
    out = ranked.unionByName(rest)
    return out.select("doc_id", "source", "key", "size", "source_size", "target", (F.col("size") * (F.col("base") + F.col("more"))).alias("taken"))


def take_mix(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", **options) -> DataFrame:
    """The documents that the mix takes, with their columns and size, source_size, target, taken and repeats.

    Rows of one id, source and text are one document here: their repeats add up, and the columns of one of them stay.
    Columns of docs with these five names are replaced. Null ids, sources and texts are kept as they are; documents
    without words are not taken; an empty table gives no rows.
    """
    mix = materialize(mix_sources(docs, id_col, source_col, text_col, **options), "mix")
    added = ["size", "source_size", "target", "taken", "repeats"]
    taken = mix.where("taken > 0").groupBy("key").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"))
    taken = taken.withColumn("repeats", (F.col("taken") / F.col("size")).cast("int")).withColumnRenamed("key", "__key")
    own = docs.withColumn("__key", mix_key(id_col, source_col, text_col)).drop(*added)
    if mix.groupBy("key").count().where("count > 1").limit(1).count():
        own = own.dropDuplicates(["__key"])
    return own.join(taken.hint("shuffle_hash"), "__key").drop("__key")
