"""The directory layout, fixtures, facets and tiers."""

import base64
import hashlib
import json

import pytest
from annalist.operators import integrity
from annalist.operators.compose import compose
from annalist.operators.retention import Policy
from annalist.sources import facets, fixtures, layout
from annalist.sources.table import LedgerTable
from annalist.sources.tiers import TieredTable
from pyspark.sql import functions as F
from tests.test_table_and_streams import commands


def put(tmp, partition, revisions, head, broken=()):
    digest = hashlib.sha256(f"app::users::{partition}".encode()).hexdigest()
    folder = tmp / digest[:2] / digest
    (folder / "history").mkdir(parents=True)
    for r in revisions:
        body = {"root": "App", "path": "users", "partition": partition, "revision": r, "globalPosition": r * 10, "operation": "Set", "status": "Ready", "payload": base64.b64encode(b"v").decode()}
        (folder / "history" / f"{r:020d}.json").write_text("{" if r in broken else json.dumps(body))
        if r == head:
            (folder / "head.json").write_text(json.dumps(body))


def test_layout(spark, tmp_path):
    put(tmp_path, "a", [1, 2, 3], 2, broken=[1])
    put(tmp_path, "b", [1], None)
    (tmp_path / "_changes.log").write_text("20\tApp\tusers\ta\t2\n30\tApp\tusers\ta\t3\n10\tApp\tusers\tb\t1\n11\tAp")
    p = str(tmp_path)
    history, heads, log = layout.read_history(spark, p), layout.read_heads(spark, p), layout.read_log(spark, p)
    assert sorted((r.address, r.revision, r.readable) for r in history.collect() if r.address) == [("app::users::a", 2, True), ("app::users::a", 3, True), ("app::users::b", 1, True)]
    assert [(r.revision, r.readable) for r in history.where("not readable").collect()] == [(1, False)]
    assert {r.address: r.revision for r in layout.latest(heads, history).collect()} == {"app::users::a": 3, "app::users::b": 1}
    good = history.where("readable").select("address", "revision", "global_position", "readable")
    assert [r.reason for r in integrity.compact(log, good).orderBy("line_no").collect()] == ["keep", "keep", "keep", "torn"]
    assert {(r.action, r.address) for r in integrity.repair_plan(heads, good).collect()} == {("rewrite-head", "app::users::a"), ("rewrite-head", "app::users::b")}


def test_fixtures(spark, tmp_path):
    rows = spark.createDataFrame([("b", "default", "Ready", 1.0), ("a", "7", "Invalidated", 2.0), ("c", "default", "Cleared", None)], fixtures.KIND)
    fixtures.save(rows, str(tmp_path / "f.json"), "app", "x")
    body = fixtures.load(str(tmp_path / "f.json"), "app")
    got = [(r.path, r.operation, r.value) for r in fixtures.apply(spark, body).orderBy("seq").collect()]
    assert got == [("a", "Set", 2.0), ("a", "Invalidated", None), ("b", "Set", 1.0), ("c", "Cleared", None)]
    with pytest.raises(KeyError):
        fixtures.apply(spark, body, {"a"})
    assert fixtures.apply(spark, body, {"a"}, "skip").count() == 2
    with pytest.raises(ValueError):
        fixtures.load(str(tmp_path / "f.json"), "other")
    seeds = fixtures.Seeds().set("a", 1).invalidate("a").clear("b")
    assert [r.operation for r in seeds.commands(spark).orderBy("seq").collect()] == ["Set", "Invalidated", "Cleared"]


def test_json_facet(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k long").withColumn("s", F.struct(F.lit("x").alias("v")))
    answers = {"u1": '{"n":"a"}', "u2": "null"}
    source = facets.from_json("web", base, "k", F.concat(F.lit("u"), F.col("k").cast("string")), "n string", lambda s, v: F.struct(F.concat(s["v"], v["n"]).alias("v")), fetch=lambda u, _: answers.get(u))
    got = {r.k: (r.s.v, r.status) for r in compose(base, "k", "s", [source]).collect()}
    assert got == {1: ("xa", "Ready"), 2: ("x", "Faulted"), 3: ("x", "Faulted")}


def test_tiers(spark, tmp_path):
    hot, cold = LedgerTable(spark, str(tmp_path / "h")), LedgerTable(spark, str(tmp_path / "c"))
    t = TieredTable(hot, cold)
    t.append(commands(spark, [("a", 1, "Any", None, 1.0), ("b", 2, "Any", None, 2.0)]))
    assert t.lag().first().caught_up and {r.tier for r in t.latest().collect()} == {"hot"}
    cold.append(commands(spark, [("a", 3, "Any", None, 3.0), ("c", 4, "Any", None, 4.0)]))
    lag = t.lag().first()
    assert (lag.partitions_behind, lag.gap) == (2, 2)
    assert {(r.address, r.revision) for r in t.latest(False).collect()} >= {("c", 1)}
    t.prune(Policy(max_revisions=1))
    assert not t.failures and t.feed().count() == 3
    hot.import_records = None  # a failing replica
    t.append(commands(spark, [("d", 5, "Any", None, 1.0)]))
    assert t.failures and cold.catalog().count() == 4
