"""Connected components of an edge table, by alternating large and small stars, one checkpoint a round."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import materialize

#: A table of minima of at most so many rows (16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def _minima(df: DataFrame) -> DataFrame:
    """A side of a join by node, written first: so Spark can broadcast it, or split the hot nodes of the other side."""
    df = materialize(df, "minima")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def stars(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The same components as stars: (smallest node, other node), by union-find within a task's own edges."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = sorted(set(a) | set(b))
    roots = [find(x) for x in nodes]
    return [r for r, x in zip(roots, nodes) if r != x], [x for r, x in zip(roots, nodes) if r != x]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b), both not null -> (node, root): every node of an edge and the smallest node it can reach.

    A round sends each edge to the smallest neighbour of its ends. Minima are aggregated before the shuffle and joined
    back by node, so that a node of very many edges is never gathered. Self edges are ignored; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e = materialize(e, "edges")
    for _ in range(rounds):
        # Large star: every neighbour above a node goes to that node's smallest neighbour (or itself).
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = _minima(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = materialize(large, "edges")
        small = _minima(large.groupBy("hi").agg(F.min("lo").alias("m")))
        pairs = large.join(small, "hi").select("m", F.explode(F.array("lo", "hi")).alias("v"))
        e = materialize(pairs.where("m <> v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct(), "edges")
        # Done when every node has one edge upwards and no upper end has an edge of its own.
        ends = e.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(e.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        if not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up = 1 and low = 1)").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
