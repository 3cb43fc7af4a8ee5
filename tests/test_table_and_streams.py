"""The durable table, manifests, leases and streams."""

import threading

import pytest
from annalist.functions.freshness import ts
from annalist.operators import retention
from annalist.operators.retention import Policy
from annalist.plans.manifest import Root, supports
from annalist.sources.stores import Stores
from annalist.sources.table import Conflict, Lease, LedgerTable
from annalist.streaming.feed import Cursor, MemorySink, Outbox, deliver, feed_stream, stream_fold, subscribe
from pyspark.sql import functions as F


def commands(spark, rows):
    df = spark.createDataFrame(rows, "address string, seq long, condition string, expected long, value double")
    return df.select("*", ts("2024-01-01 00:00:00").alias("occurred_at"), F.lit("Set").alias("operation"), F.lit("Ready").alias("status"), F.lit(True).alias("has_value"), F.lit(8).cast("long").alias("payload_bytes"), ts("2024-01-02 00:00:00").alias("fresh_until"), ts("2024-01-03 00:00:00").alias("serve_until"), F.lit(1).alias("schema_version"), F.lit("test").alias("source"), F.lit("double").alias("value_type"))


def test_table(spark, tmp_path):
    t = LedgerTable(spark, str(tmp_path / "t"))
    assert t.records().count() == 0 and t.catalog().count() == 0
    got = {r.seq: (r.outcome, r.revision) for r in t.append(commands(spark, [("a", 1, "Absent", None, 1.0), ("b", 2, "Absent", None, 2.0), ("a", 3, "Absent", None, 3.0)])).collect()}
    assert got == {1: ("appended", 1), 2: ("appended", 1), 3: ("conflict", 1)}
    pinned = t.version()
    t.append(commands(spark, [("a", 4, "AtRevision", 1, 4.0), ("a", 5, "Any", None, 5.0)]))
    assert [(r.global_position, r.address, r.revision) for r in t.feed().collect()] == [(1, "a", 1), (2, "b", 1), (3, "a", 2), (4, "a", 3)]
    assert t.records(pinned).count() == 2 and t.feed(2, 1).first().global_position == 3
    assert [r.revision for r in t.history("a", 2).collect()] == [3, 2]
    conflict = t.append(commands(spark, [("a", 6, "Absent", None, 0.0)]))
    assert conflict.first().outcome == "conflict" and t.version() == pinned + 1
    extra = t.records().where("address = 'b'").withColumn("global_position", F.lit(50).cast("long"))
    t.import_records(extra)
    t.append(commands(spark, [("c", 7, "Any", None, 7.0)]))
    assert {r.address: r.last_position for r in t.catalog().collect()} == {"a": 4, "b": 50, "c": 51}
    t.prune(Policy(max_revisions=1))
    assert [r.global_position for r in t.feed().collect()] == [4, 50, 51]
    refs = spark.createDataFrame([("a",), ("q",)], "address string")
    assert {r.address: r.status for r in t.capture(refs).collect()} == {"a": "Ready", "q": "Absent"}
    t.vacuum()
    assert t.records().count() == 3
    with pytest.raises(Conflict):
        t._publish(t.version() - 1, [], [], 0)


def test_racing_writers(spark, tmp_path):
    t = LedgerTable(spark, str(tmp_path / "t"))
    out, gate = [], threading.Barrier(3)

    def race(i):
        gate.wait()
        out.append(t.append(commands(spark, [("a", i, "Absent", None, float(i))])).first().outcome)

    threads = [threading.Thread(target=race, args=(i,)) for i in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(out) == ["appended", "conflict", "conflict"] and t.records().count() == 1


def test_lease(tmp_path):
    now = [0.0]
    lease = Lease(str(tmp_path), lambda: now[0])
    a = lease.acquire("x", 10)
    assert a and lease.acquire("x", 10) is None and lease.renew("x", a, 10)
    now[0] = 20
    assert not lease.renew("x", a, 10)
    b = lease.acquire("x", 10)
    assert b and not lease.release("x", a) and lease.release("x", b)


def test_manifest():
    def declare(flip):
        r = Root("App", max_revisions=9)
        c = r.container("users", fresh_for="5 minutes")
        c.defaults.max_bytes = 5
        names = ["user", "profile"]
        for n in reversed(names) if flip else names:
            c.state(n, dict[str, int], partitioned=n == "user", sources=["a", "b"])
        return r

    m = declare(False).build()
    assert m.fingerprint() == declare(True).build().fingerprint()
    assert m.state("Users/USER").settings.fresh_for == "5 minutes" and m.state("users/user").settings.max_revisions == 9
    assert m.address("users/user", " 7 ") == "app::users/user::7" and m.parent("users/user") == "users"
    assert "users/profile" in m.to_mermaid() and '"fingerprint"' in m.to_json()
    with pytest.raises(ValueError):
        m.address("users/profile", "7")
    with pytest.raises(KeyError):
        m.state("none")
    r = declare(False)
    r.build()
    with pytest.raises(ValueError):
        r.state("late", int)
    r = Root("x")
    r.state("a", int, sources=["S", "s"], migrations=[1, 2], schema_version=2)
    r.state("A", int)
    with pytest.raises(ValueError, match="source s declared 2 times"):
        r.build()
    assert supports(type("S", (), {"capabilities": {"feed"}})(), "feed") and not supports(object(), "lease")


def test_outbox(spark, tmp_path):
    rows = [(i, f"m{i}") for i in range(1, 8)]
    feed = lambda c, n: spark.createDataFrame(rows, "global_position long, message_id string").where(F.col("global_position") > c).orderBy("global_position").limit(n)
    sink, cursor = MemorySink(), Cursor(str(tmp_path / "c"))
    assert Outbox(cursor, sink, 3).run(feed) == "Completed" and cursor.get() == 7 and len(sink.messages) == 7
    assert cursor.advance(2) == 7
    again = Cursor(str(tmp_path / "d"))
    assert Outbox(again, sink, 2).run(feed) == "Completed" and len(sink.messages) == 7
    sink.messages[4] = "other"
    box = Outbox(Cursor(str(tmp_path / "e")), sink, 2, poison_after=2)
    with pytest.raises(ValueError):
        box.run(feed)
    assert box.run(feed) == "Completed" and box.cursor.get() == 7
    lease = Lease(str(tmp_path / "l"))
    lease.acquire("outbox", 99)
    assert Outbox(cursor, sink, lease=lease).run(feed) == "LeaseUnavailable"


def test_streams(spark, tmp_path):
    t = LedgerTable(spark, str(tmp_path / "t"))
    t.append(commands(spark, [("a", i, "Any", None, float(i)) for i in range(5)] + [("b", 9, "Any", None, 1.0)]))
    changes = feed_stream(spark, f"{t.path}/data", t.schema)
    messages = changes.select("global_position", F.concat_ws("#", "address", F.col("revision").cast("string")).alias("message_id"))
    for _ in range(2):
        deliver(messages, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 6
    deliver(messages, str(tmp_path / "sink"), str(tmp_path / "cp2")).awaitTermination()  # delivered again from the start
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 6
    seen = []
    subscribe(changes, lambda df: seen.extend(r.global_position for r in df.collect()), str(tmp_path / "cp3"), "Set").awaitTermination()
    assert seen == [1, 2, 3, 4, 5, 6]


def test_stateful_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = LedgerTable(spark, str(tmp_path / "t"))
    changes = feed_stream(spark, f"{t.path}/data", t.schema, 1).select("address", "global_position", "operation", "value")
    q = lambda: stream_fold(changes).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    t.append(commands(spark, [("a", 1, "Any", None, 1.0), ("a", 2, "Any", None, 2.0)]))
    q()
    t.append(commands(spark, [("a", 3, "Any", None, 3.0), ("b", 4, "Any", None, 4.0)]))
    q()
    got = sorted((r.address, r.revision, r.value) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 4.0)]


def test_imports_and_prunes_touch_only_their_folders(spark, tmp_path):
    t = LedgerTable(spark, str(tmp_path / "t"))
    for k in range(3):
        t.append(commands(spark, [(f"a{k}", i, "Any", None, float(i)) for i in range(4)]))
    live, _ = t.state()
    old = t.records().where("address = 'a1' and revision = 2").withColumn("value", F.lit(99.0))
    t.import_records(old)
    after, _ = t.state()
    assert live[0] in after and live[2] in after and live[1] not in after
    got = {(r.address, r.revision): r.value for r in t.records().collect()}
    assert len(got) == 12 and t.records().count() == 12 and got["a1", 2] == 99.0 and got["a1", 1] == 0.0
    before = t.version()
    assert t.prune(retention.Policy(max_revisions=4)) == before
    t.append(commands(spark, [("a0", 1, "Any", None, 7.0)]))
    kept_folders = set(t.state()[0])
    t.prune(retention.Policy(max_revisions=4))
    assert len(kept_folders & set(t.state()[0])) == len(kept_folders) - 1 and t.records().count() == 12


def test_two_messages_at_a_position(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m1"), (2, "m2"), (2, "other")], "global_position long, message_id string")
    rows.write.parquet(str(tmp_path / "in"))
    messages = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="two messages at one position"):
        deliver(messages, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()


def test_stores():
    s = Stores(Main=1, hot=2)
    assert s.resolve("MAIN") == 1 and s.resolve("Hot") == 2
    with pytest.raises(KeyError, match="there are: hot, Main"):
        s.resolve("cold")
    with pytest.raises(ValueError):
        s.register("main", 3)
