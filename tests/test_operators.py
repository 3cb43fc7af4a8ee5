"""Facts about the ledger: conditional writes, feed, retention, import, catalogue, loading, identity, integrity."""

import random

import pytest
from annalist.functions import freshness, identity
from annalist.functions.records import validate
from annalist.operators import compose, diagnostics, integrity, outbox, reads, retention, routing, writes
from annalist.sources.export import read_export, write_export
from pyspark.sql import functions as F


def history(spark, sizes, operation="Set", address="a"):
    rows = [(address, i + 1, i + 1, f"2024-01-01 {i:02d}:00:00", operation if isinstance(operation, str) else operation[i], s) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "address string, revision long, global_position long, occurred_at string, operation string, payload_bytes long").withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


def kept(df):
    return sorted(r.revision for r in df.collect())


@pytest.mark.parametrize(
    "sizes, policy, want",
    [
        ([10] * 6, retention.Policy(max_revisions=3), [4, 5, 6]),
        ([10] * 6, retention.Policy(max_revisions=1), [6]),
        ([10] * 6, retention.Policy(age="interval 150 minutes"), [4, 5, 6]),
        ([10] * 6, retention.Policy(age="interval 3 hours"), [3, 4, 5, 6]),
        ([10] * 6, retention.Policy(age="interval 0 hours"), [6]),
        ([10] * 6, retention.Policy(max_bytes=25), [5, 6]),
        ([10] * 6, retention.Policy(max_bytes=1), [6]),
        ([5, 5, 5, 100, 10, 10], retention.Policy(max_bytes=30), [2, 3, 5, 6]),
        ([], retention.Policy(max_bytes=30), []),
    ],
)
def test_retention(spark, sizes, policy, want):
    now = freshness.ts("2024-01-01 05:00:00")
    rows = history(spark, sizes)
    once = retention.prune(rows, policy, now)
    assert kept(once) == want
    assert kept(retention.prune(once, policy, now)) == kept(once)


def test_retention_keeps_others_and_heads(spark):
    rows = history(spark, [10] * 4).unionByName(history(spark, [7, 7], address="b"))
    out = retention.prune(rows, retention.Policy(max_revisions=2)).groupBy("address").count().collect()
    assert {(r.address, r["count"]) for r in out} == {("a", 2), ("b", 2)}
    tombs = history(spark, [10, 0, 10, 0], ["Set", "Cleared", "Set", "Cleared"])
    assert kept(retention.prune(tombs, retention.Policy(keep_tombstones=False))) == [1, 3, 4]
    assert kept(retention.prune(tombs, retention.Policy(max_bytes=10))) == [2, 3, 4]
    # tombstones go before revisions are counted
    assert kept(retention.prune(tombs, retention.Policy(keep_tombstones=False, max_revisions=2))) == [3, 4]


def test_conditional_append(spark):
    cs = [(1, "Any", None), (2, "Absent", None), (3, "AtRevision", 1), (4, "AtRevision", 1), (5, "AtRevision", None), (6, "Any", None)]
    df = spark.createDataFrame([("a", *c) for c in cs] + [("b", 7, "Absent", None), ("b", 8, "Absent", None)], "address string, seq long, condition string, expected long")
    got = {r.seq: (r.outcome, r.revision) for r in writes.conditional_append(df).collect()}
    assert got == {1: ("appended", 1), 2: ("conflict", 1), 3: ("appended", 2), 4: ("conflict", 2), 5: ("conflict", 2), 6: ("appended", 3), 7: ("appended", 1), 8: ("conflict", 1)}
    heads = spark.createDataFrame([("b", 5)], "address string, revision long")
    assert {r.seq: r.outcome for r in writes.conditional_append(df, heads).collect()}[7] == "conflict"


def test_conditional_append_against_a_model(spark):
    rnd = random.Random(9)
    rows = [(f"a{rnd.randrange(6)}", i, rnd.choice(["Any", "Absent", "AtRevision"]), rnd.randrange(5)) for i in range(300)]
    model, want = {}, {}
    for a, seq, c, e in rows:
        r = model.get(a, 0)
        ok = c == "Any" or (c == "Absent" and r == 0) or (c == "AtRevision" and r == e)
        model[a] = r + ok
        want[seq] = ("appended" if ok else "conflict", model[a])
    df = spark.createDataFrame(rows, "address string, seq long, condition string, expected long").repartition(5)
    assert {r.seq: (r.outcome, r.revision) for r in writes.conditional_append(df).collect()} == want


def test_feed_pages_are_complete_and_keep_collisions(spark):
    rows = [(p, f"a{i}", 1) for i, p in enumerate([3, 3, 3, 10, 70_000, 70_001, 200_000])]
    df = spark.createDataFrame(rows, "global_position long, address string, revision long")
    assert [r.address for r in reads.read_feed(df).collect()] == [f"a{i}" for i in range(7)]
    assert [r.global_position for r in reads.read_feed(df, 10, 2).collect()] == [70_000, 70_001]
    with pytest.raises(ValueError):
        reads.read_feed(df, 0, 0)
    pages = {(r.global_position, r.address): r.page for r in reads.feed_pages(df, 2).collect()}
    assert len(pages) == 7 and len({pages[3, f"a{i}"] for i in range(3)}) == 1
    order = sorted(pages)
    assert [pages[k] for k in order] == sorted(pages.values())


def test_reads(spark):
    rows = history(spark, [1, 2, 3]).unionByName(history(spark, [9], address="b"))
    assert {(r.address, r.revision) for r in reads.read_latest(rows).collect()} == {("a", 3), ("b", 1)}
    assert kept(reads.read_history(rows.where("address = 'a'"), 2)) == [2, 3]
    assert kept(reads.read_history(rows.where("address = 'a'"), 2, before=3, newest_first=False)) == [1, 2]
    assert kept(reads.read_history(rows.where("address = 'a'"), 9, since=freshness.ts("2024-01-01 01:00:00"))) == [2, 3]
    assert [r.revision for r in reads.history_of(rows, "a", 0).collect()] == [3]
    assert reads.read_latest(rows.where("false")).count() == 0
    assert reads.partition_catalog(rows.where("false")).count() == 0
    lag = reads.replication_lag(rows, rows.where("address = 'a' and revision < 3")).first()
    assert (lag.partitions_behind, lag.gap, lag.caught_up) == (2, 1, False)
    lag = reads.replication_lag(rows, rows).first()
    assert (lag.partitions_behind, lag.gap, lag.caught_up) == (0, 0, True)
    assert reads.replication_lag(rows.where("false"), rows.where("false")).first().caught_up


def test_capture(spark):
    rows = history(spark, [1, 2, 3]).withColumns({"status": F.lit("Ready"), "has_value": F.lit(True)})
    refs = spark.createDataFrame([("a",), ("a",), ("zz",)], "address string")
    got = {r.address: (r.status, r.revision) for r in reads.capture(refs, rows, 2).collect()}
    assert got == {"a": ("Ready", 2), "zz": ("Absent", 0)}
    assert reads.capture_position(reads.capture(refs, rows)).first().capture_position == 3


def test_import(spark):
    cols = ["address", "revision", "global_position", "operation"]
    have = history(spark, [1, 2, 3]).select(*cols)
    new = spark.createDataFrame([("a", 2, 90, "Imported"), ("a", 2, 80, "Imported"), ("c", 4, 7, "Imported")], "address string, revision long, global_position long, operation string")
    once = writes.import_exact(have, new, cols).select(*cols)
    twice = writes.import_exact(once, new, cols).select(*cols)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {(r.address, r.revision): r.global_position for r in once.collect()} == {("a", 1): 1, ("a", 2): 90, ("a", 3): 3, ("c", 4): 7}
    assert {r.address: r.revision for r in reads.read_latest(once).collect()} == {"a": 3, "c": 4}


def test_freshness_edges(spark):
    rows = spark.createDataFrame([("x", "Ready", True, "2024-01-01 00:00:00"), ("y", "Ready", True, "2023-12-31 23:59:59"), ("z", "Invalidated", True, "2023-01-01 00:00:00"), ("c", "Cleared", False, "2025-01-01 00:00:00"), ("s", "Stale", True, "2025-01-01 00:00:00"), ("n", "Ready", True, None)], "address string, status string, has_value boolean, until string")
    rows = rows.withColumn("fresh_until", F.col("until").cast("timestamp_ntz")).withColumn("serve_until", F.col("fresh_until"))
    got = {r.address: (r.status, r.is_fresh, r.is_stale) for r in freshness.snapshot(rows, freshness.ts("2024-01-01 00:00:00")).collect()}
    assert got == {"x": ("Ready", True, False), "y": ("Stale", False, True), "z": ("Invalidated", False, True), "c": ("Cleared", False, False), "s": ("Ready", True, False), "n": ("Ready", False, True)}


def test_decode(spark):
    df = spark.createDataFrame([('{"k":1}', 1), ('{"n":5}', 2)], "p string, v int")
    value = freshness.decode(F.col("p"), F.col("v"), 2, {1: "k long", 2: "n long"}, {1: lambda x: F.struct((x["k"] + 100).alias("n"))})
    assert [r[0].n for r in df.select(value).collect()] == [101, 5]
    with pytest.raises(Exception, match="no migration"):
        spark.createDataFrame([("{}", 7)], "p string, v int").select(value).collect()


def test_identity(spark):
    cases = {" \\Users//A/ ": "users/a", "": "", "///": "", "a/b": "a/b", "/X\\\\y": "x/y"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", identity.normalize_path(F.col("p")).alias("n")).collect()} == cases
    bad = spark.createDataFrame([("a\tb",), ("ab",)], "p string").select(identity.path_is_valid(F.col("p"))).collect()
    assert [r[0] for r in bad] == [False, True]
    a = spark.range(1).select(identity.canonical_address(F.lit(" App "), F.lit("/U/"), F.lit(" ")).alias("a")).first().a
    assert a == "app::u::default"
    assert identity.stable_type_name(list[dict[str, int]]) == "list[dict[str,int]]"


def test_validation(spark):
    df = spark.createDataFrame([(0, None, "Absent", " ", 0, None, False)], "revision long, global_position long, status string, value_type string, schema_version int, source string, has_value boolean")
    df = df.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("occurred_at", "fresh_until", "serve_until")})
    assert set(validate(df).first().violations) == {"revision", "global_position", "occurred_at", "status_absent", "value_type", "schema_version", "source"}


def test_compose(spark):
    base = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string").select("k", F.when(F.col("v").isNotNull(), F.struct("v")).alias("s"))
    facet = lambda name, keys: compose.Source(name, spark.createDataFrame([(k, name) for k in keys], "k long, n string").select("k", F.struct("n").alias("value")), lambda s, v: F.struct(F.concat_ws("", s["v"], v["n"]).alias("v")))
    run = lambda **o: {r.k: (r.s.v if r.s else None, r.status, r.completeness, r.error_code, r.faulted) for r in compose.compose(base, "k", "s", [facet("a", [1, 2]), facet("b", [1])], **o).collect()}
    assert run() == {1: ("xab", "Ready", "complete", None, ""), 2: (None, "Faulted", None, "loader-failed", "b"), 3: ("z", "Faulted", None, "loader-failed", "a, b")}
    assert run(best_effort=True) == {1: ("xab", "Ready", "complete", None, ""), 2: ("a", "Ready", "partial", "partial-load", "b"), 3: ("z", "Faulted", None, "loader-failed", "a, b")}
    with_initial = run(best_effort=True, initial=F.struct(F.lit("i").alias("v")))
    assert with_initial[2][0] == "ia" and with_initial[3][1] == "Faulted"
    m = spark.range(1).select(compose.merge_metadata(F.create_map(F.lit("A"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3"))).alias("m")).first().m
    assert m == {"a": "3", "b": "2"}


def test_routing(spark):
    states = spark.createDataFrame([("u/p", True, ["Go"]), ("s", False, ["go"])], "path string, partitioned boolean, signals array<string>")
    handles = spark.createDataFrame([("u/p", "1"), ("u/p", "2")], "path string, partition string")
    signals = spark.createDataFrame([(1, "GO", None, ""), (2, "go", "9", ""), (3, "go", "default", ""), (4, "go", None, "u"), (5, "no", None, "")], "signal_id long, name string, partition string, scope string")
    got = {(r.signal_id, r.path, r.partition) for r in routing.signal_targets(signals, states, handles).collect()}
    assert got == {(1, "u/p", "1"), (1, "u/p", "2"), (1, "s", "default"), (2, "u/p", "9"), (3, "u/p", "default"), (3, "s", "default"), (4, "u/p", "1"), (4, "u/p", "2")}
    paths = spark.createDataFrame([("a/b/c",), ("a",), ("ab/c",)], "path string")
    parents = routing.container_parents(paths, spark.createDataFrame([("a",), ("a/b",)], "path string"))
    assert {r.path: r.parent for r in parents.collect()} == {"a/b/c": "a/b", "a": "", "ab/c": ""}


def test_anchored_rate_limit(spark):
    rows = [(0, s, i) for i, s in enumerate([5, 6, 7, 64, 65, 66, 200])]
    df = spark.createDataFrame(rows, "store long, second long, event_id long")
    got = {r.event_id: r.reported for r in diagnostics.anchored_rate_limit(df, "store", "second", "event_id", 60, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True}


def test_integrity(spark):
    lines = ["1\tApp\tu\tx\t1", "2\tApp\tu\tx\t2", "2\tApp\tu\tx\t2", "9\tApp\tu\tx\t3", "5\tApp\tu\tgone\t1", "6\tApp"]
    df = spark.createDataFrame([(i, t, i == len(lines) - 1) for i, t in enumerate(lines)], "line_no long, text string, last boolean")
    log = integrity.parse_log(df)
    hist = spark.createDataFrame([("app::u::x", i, i, True) for i in (1, 2, 3)], "address string, revision long, global_position long, readable boolean")
    reasons = [r.reason for r in integrity.compact(log, hist).orderBy("line_no").collect()]
    assert reasons == ["keep", "keep", "duplicate", "mismatch", "dangling", "torn"]
    heads = spark.createDataFrame([("app::u::y", 1)], "address string, revision long")
    kinds = sorted(r.kind for r in integrity.verify(heads, hist, log).collect())
    assert kinds == ["ChangeLogPositionMismatch", "DanglingChangeLogLine", "MissingHead", "MissingHistoryFile", "TornChangeLogTail"]
    assert sorted(r.action for r in integrity.repair_plan(heads, hist).collect()) == ["restore-history", "rewrite-head"]
    broken = integrity.parse_log(df.withColumn("last", F.lit(False)))
    with pytest.raises(ValueError):
        integrity.compact(broken, hist)


def test_outbox_functions(spark):
    old = spark.createDataFrame([("c", 5)], "consumer string, position long")
    assert outbox.advance_cursor(old, spark.createDataFrame([("c", 3), ("d", 1)], "consumer string, position long")).where("consumer = 'c'").first().position == 5
    delays = [r[0] for r in spark.range(10).select(outbox.backoff(F.col("id"), 100, 1000)).collect()]
    assert delays == [100, 200, 400, 800] + [1000] * 6


def test_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("app::a::default", 1, 1, "Set", "Ready", 1.5, True, 1), ("app::a::default", 2, 2, "Cleared", "Cleared", None, False, 1), ("other::a::default", 1, 3, "Set", "Ready", 2.0, True, 1)], "address string, revision long, global_position long, operation string, status string, value double, has_value boolean, schema_version int")
    write_export(rows, str(tmp_path / "e"), "App", "f1")
    back = read_export(spark, str(tmp_path / "e"), "app", "f1")
    assert [(r.revision, r.payload) for r in back.orderBy("revision").collect()] == [(1, "1.5000"), (2, None)]
    for bad in (dict(root="x"), dict(root="app", fingerprint="f2")):
        with pytest.raises(ValueError):
            read_export(spark, str(tmp_path / "e"), **bad)


def test_long_folds(spark):
    """One address of very many commands: linear, in one pass."""
    n = 300_000
    cs = spark.range(n).select(F.lit("hot").alias("address"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "AtRevision").otherwise("Any").alias("condition"), (F.col("id") % 5).alias("expected"))
    got = {r.outcome: (r.n, r.top) for r in writes.conditional_append(cs).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("top")).collect()}
    revision, conflicts = 0, 0
    for i in range(n):
        if i % 3 == 0 and i % 5 != revision:
            conflicts += 1
        else:
            revision += 1
    assert got["appended"] == (revision, revision) and got["conflict"][0] == conflicts
    rows = spark.range(n).select(F.lit("hot").alias("address"), F.col("id").alias("revision"), (F.col("id") % 7 + 1).alias("payload_bytes"))
    assert retention.prune(rows, retention.Policy(max_bytes=10**6)).agg(F.sum("payload_bytes")).first()[0] == 10**6


def test_span_offsets(spark):
    counts = spark.createDataFrame([(s, s % 4 + 1) for s in (0, 3, 4, 9, 10, 100, 101)], "__span long, __c long")
    got = {r["__span"]: r["__before"] for r in reads.span_offsets(counts, 4).collect()}
    want, total = {}, 0
    for s in (0, 3, 4, 9, 10, 100, 101):
        want[s], total = total, total + s % 4 + 1
    assert got == want


def test_verify_files(spark):
    heads = spark.createDataFrame([("a", 1)], "address string, revision long")
    hist = spark.createDataFrame([("a", 1, 1, True)], "address string, revision long, global_position long, readable boolean")
    log = integrity.parse_log(spark.createDataFrame([(0, "x", False)], "line_no long, text string, last boolean"))
    place = hist.select(identity.history_file(F.col("address"), F.col("revision"))).first()[0]
    wrong = "ff/ff" + "0" * 62
    files = [(place, "a"), (place.replace("history/", "history/.") + ".tmp", None), ("_changes.log.12.tmp", None), (f"root/{wrong}/history/1.json", "a"), (f"root/{wrong}/head.json", "a"), ("_changes.log", None)]
    got = sorted((r.kind, r.address) for r in integrity.verify(heads, hist, log, spark.createDataFrame(files, "path string, address string")).collect())
    assert got == [("MalformedChangeLogLine", None), ("MisplacedStreamDirectory", "a"), ("OrphanedTemporaryFile", None), ("OrphanedTemporaryFile", None)]


def test_comparer_and_codec(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "X"), ("a", 3, "y"), ("a", 4, None), ("a", 5, None)], "address string, n long, v string")
    same = lambda a, b: F.lower(a).eqNullSafe(F.lower(b))
    assert sorted(r.n for r in writes.suppress_equivalent(rows, "v", "n", same).collect()) == [1, 3, 4]
    assert sorted(r.n for r in writes.suppress_equivalent(rows, "v", "n").collect()) == [1, 2, 3, 4]
    pipe = freshness.Codec("pipe", lambda v: F.concat_ws("|", v["a"].cast("string"), v["b"]), lambda p, _: F.struct(F.split(p, "[|]")[0].cast("int").alias("a"), F.split(p, "[|]")[1].alias("b")))
    v = rows.limit(1).select(F.struct(F.lit(7).alias("a"), F.lit("z").alias("b")).alias("v"))
    e = v.select(pipe.envelope(F.col("v")).alias("e"), F.lit(2).alias("version")).select("e.*", "version")
    assert tuple(e.first()) == ("7|z", "pipe", "application/octet-stream", 2)
    assert tuple(e.select(freshness.decode(F.col("payload"), F.col("version"), 2, {2: "a int, b string"}, {}, pipe).alias("v")).first().v) == (7, "z")
    j = v.select(freshness.JSON.envelope(F.col("v")).alias("e")).select("e.*").first()
    assert tuple(j) == ('{"a":7,"b":"z"}', "json", "application/json")


def test_reobserve_and_required_value(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = spark.createDataFrame([("a", "Ready", True, at(6), at(9)), ("b", "Faulted", True, at(6), at(9)), ("c", "Cleared", False, None, None)], "address string, status string, has_value boolean, fresh_until string, serve_until string")
    rows = rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("fresh_until", "serve_until")})
    first = freshness.snapshot(rows, freshness.ts(at(5)))
    later = {r.address: (r.status, r.is_stale, r.can_serve) for r in freshness.reobserve(first, freshness.ts(at(8))).collect()}
    assert {r.address: r.status for r in first.collect()} == {"a": "Ready", "b": "Faulted", "c": "Cleared"}
    assert later == {"a": ("Stale", True, True), "b": ("Faulted", True, True), "c": ("Cleared", False, False)}
    assert {r.address: r.can_serve for r in freshness.reobserve(first, freshness.ts(at(10))).collect()} == {"a": False, "b": False, "c": False}
    assert spark.range(1).select(freshness.required_value(F.lit(3), F.lit("a::b"))).first()[0] == 3
    with pytest.raises(Exception, match="no usable value at a::b"):
        spark.range(1).select(freshness.required_value(F.lit(None).cast("int"), F.concat(F.lit("a::"), F.lit("b")))).collect()
