"""Plans that scale: filters and columns reach the scan, aggregates are partial, no cross joins or single-partition sorts of records."""

import pytest
from annalist.operators import reads, retention, writes
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "ledger")
    rows = spark.range(2000).select(F.concat(F.lit("a"), (F.col("id") % 50).cast("string")).alias("address"), (F.col("id") + 1).alias("global_position"), F.floor(F.col("id") / 50).alias("revision"), F.lit("Set").alias("operation"), F.lit(5).cast("long").alias("payload_bytes"), F.lit("x" * 100).alias("wide"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_feed_is_a_pushed_down_range(stored):
    p = plan(reads.read_feed(stored.select("global_position", "address"), 1500, 10))
    assert "GreaterThan(global_position,1500)" in p and "TakeOrderedAndProject" in p
    assert "wide" not in p.split("ReadSchema:")[-1]


def test_latest_is_aggregated_before_the_shuffle(stored):
    p = plan(reads.read_latest(stored, ["revision", "operation"]))
    assert p.count("Exchange hashpartitioning(address") == 1 and "partial_max_by" in p and "wide" not in p.split("ReadSchema:")[-1]


def test_pages_and_positions_have_no_global_window_over_records(stored):
    for df in (reads.feed_pages(stored.select("global_position", "address"), 100), writes.allocate_positions(stored.select("global_position"), "global_position", 0)):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
        assert df.count() == 2000


def test_retention_is_one_exchange_by_address_until_the_byte_budget(stored):
    p = plan(retention.prune(stored.drop("wide"), retention.Policy(keep_tombstones=False, max_revisions=3)))
    physical = p.split("== Physical Plan ==")[-1]
    assert physical.count("Exchange hashpartitioning(address") == 1
