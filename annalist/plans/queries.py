"""Queries over whole tables, one for each operator, by name. The same in DuckDB SQL is in oracles.py."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import freshness, identity, records as rec
from ..operators import compose, diagnostics, integrity, outbox, reads, retention, routing, writes
from ..sources import views
from ..streaming import feed
from ..sources.export import export_lines, parse_export

QUERIES = {}
HEAD = ["address", "revision", "global_position", "occurred_at", "operation", "status", "value", "has_value", "fresh_until", "serve_until"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _ledger(spark, d, *columns) -> DataFrame:
    out = views.ledger(spark, d)
    return out.select(*columns) if columns else out


def _high(spark, d) -> int:
    return views.table(spark, d, "events").agg(F.max("event_id")).first()[0] + 1


# --- identity ---------------------------------------------------------------------------------------------------


@query
def address_digest(spark, d):
    a = _ledger(spark, d, "address", "revision")
    return a.select("address", "revision", identity.address_digest(F.col("address")).alias("digest"), identity.history_file(F.col("address"), F.col("revision")).alias("file"))


@query
def path_normalize(spark, d):
    p = views.table(spark, d, "pages")
    raw = F.concat(F.lit(" /"), F.regexp_replace("url", "://", r"\\\\"), F.lit("//A/ "))
    return p.select("page_id", identity.normalize_path(raw).alias("path"), identity.path_is_valid(raw).alias("valid"), identity.normalize_partition(F.when(F.col("page_id") % 3 == 0, F.lit("  ")).when(F.col("page_id") % 3 == 1, " Ab ")).alias("partition"))


@query
def canonical_address(spark, d):
    c = views.table(spark, d, "customer")
    return c.select("c_custkey", identity.canonical_address(F.lit(" App"), F.concat(F.lit("\\Customers//"), "c_mktsegment"), F.col("c_custkey").cast("string")).alias("address"))


@query
def container_scope(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", F.concat_ws("/", F.lit("parts"), F.lower("p_brand"), F.lower("p_type")).alias("path"))
    scopes = ["", "parts", "parts/brand#11", "parts/brand#1"]
    return p.select("p_partkey", "path", *(identity.is_descendant(F.lit(s), F.col("path")).alias(f"in_{i}") for i, s in enumerate(scopes)))


@query
def source_status_key(spark, d):
    return views.table(spark, d, "conversations").select("conv_id", "turn", identity.source_status_key(F.concat("role", F.lit(" Läuft/"), F.col("turn").cast("string"), F.lit("#x-1.y"))).alias("key"))


@query
def container_parent(spark, d):
    paths = views.table(spark, d, "part").select(F.concat_ws("/", F.lit("parts"), F.lower("p_brand"), F.lower("p_type")).alias("path")).distinct()
    brands = views.table(spark, d, "part").where("p_size > 25").select(F.concat_ws("/", F.lit("parts"), F.lower("p_brand")).alias("path")).distinct()
    return routing.container_parents(paths, brands.unionByName(spark.createDataFrame([("parts",)], "path string")))


# --- validation and freshness -----------------------------------------------------------------------------------


@query
def record_validation(spark, d):
    r = _ledger(spark, d).withColumn("value_type", F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("value_type"))).withColumn("serve_until", F.when(F.col("event_id") % 13 == 0, F.expr("fresh_until - interval 1 second")).otherwise(F.col("serve_until"))).withColumn("has_value", F.when(F.col("event_id") % 17 == 0, ~F.col("has_value")).otherwise(F.col("has_value")))
    return rec.validate(r).select("global_position", F.array_join("violations", ",").alias("violations"))


@query
def snapshot_asof(spark, d):
    s = freshness.snapshot(reads.read_latest(_ledger(spark, d, *HEAD)), views.as_of())
    return s.select("address", "revision", "status", "value", "is_fresh", "is_stale", "can_serve")


@query
def freshness_counts(spark, d):
    s = freshness.snapshot(_ledger(spark, d, *HEAD), views.as_of())
    return s.groupBy("operation", "status", "is_fresh", "is_stale").agg(F.count(F.lit(1)).alias("n"))


@query
def read_mode_decisions(spark, d):
    s = freshness.snapshot(reads.read_latest(_ledger(spark, d, *HEAD)), views.as_of())
    rows = s.select("address", "status", "has_value", "is_fresh", F.explode(F.array(*map(F.lit, freshness.MODES))).alias("mode"))
    return freshness.read_decisions(rows, allow_last_known=F.lit(True)).select("address", "mode", "status", "needs_refresh", "in_background", "served")


@query
def schema_migration(spark, d):
    r = _ledger(spark, d, "global_position", "props", "schema_version")
    old = lambda v: F.struct((v["k"] * 10).cast("bigint").alias("k10"), F.lit("migrated").alias("origin"))
    payload = F.when(F.col("schema_version") == 1, F.col("props")).otherwise(F.to_json(F.struct((F.get_json_object("props", "$.k").cast("bigint") * 10).alias("k10"), F.lit("current").alias("origin"))))
    v = freshness.decode(payload, F.col("schema_version"), 2, {1: "k bigint", 2: "k10 bigint, origin string"}, {1: old})
    return r.select("global_position", v.alias("v")).select("global_position", "v.k10", "v.origin")


@query
def invariant_violations(spark, d):
    r = _ledger(spark, d, "global_position", "value", "payload_bytes", "has_value")
    return rec.violations_of(r, {"bounded": ~F.col("has_value") | (F.col("value") < 90), "sized": ~F.col("has_value") | (F.col("payload_bytes") > 0)}).where("violated is not null").select("global_position", "violated")


# --- reads ------------------------------------------------------------------------------------------------------


@query
def read_latest(spark, d):
    return reads.read_latest(_ledger(spark, d, *HEAD)).select("address", "revision", "global_position", "occurred_at", "operation", "value")


@query
def history_newest(spark, d):
    return reads.read_history(_ledger(spark, d, "address", "revision", "operation", "global_position"), 20)


@query
def history_since_before(spark, d):
    return reads.read_history(_ledger(spark, d, "address", "revision", "operation", "occurred_at"), 10, before=50, since=freshness.ts("2024-01-05 00:00:00"), newest_first=False).select("address", "revision", "operation")


@query
def history_snapshots(spark, d):
    return freshness.snapshot(reads.read_history(_ledger(spark, d, *HEAD), 5), views.as_of()).select("address", "revision", "status", "is_fresh", "is_stale", "can_serve")


@query
def endpoint_history(spark, d):
    h = reads.history_of(_ledger(spark, d, "address", "revision", "operation", "value"), "app::users/activity::7", 5000, 100)
    return h.select("address", "revision", "operation", F.when(F.lit(False), F.col("value")).alias("value"))


@query
def feed_page(spark, d):
    return reads.read_feed(views.raw_records(spark, d).select("global_position", "address", "event_type"), 500, 250)


@query
def feed_pages(spark, d):
    return reads.feed_pages(views.raw_records(spark, d).select("global_position", "address"), 100, 50).select("global_position", "page")


@query
def partition_catalog(spark, d):
    return reads.partition_catalog(_ledger(spark, d, "address", "revision", "global_position"))


@query
def capture_process_local(spark, d):
    refs = views.table(spark, d, "events").select(F.concat(F.lit("app::users/activity::"), F.col("user_id").cast("string")).alias("address"))
    refs = refs.unionByName(views.table(spark, d, "supplier").select(F.concat(F.lit("app::absent::"), F.col("s_suppkey").cast("string")).alias("address")))
    return reads.capture_position(reads.capture(refs, _ledger(spark, d, *HEAD)))


@query
def capture_at_position(spark, d):
    refs = views.table(spark, d, "events").select(F.concat(F.lit("app::users/activity::"), F.col("user_id").cast("string")).alias("address"))
    return reads.capture(refs, _ledger(spark, d, *HEAD), 600).select("address", "status", "revision", "global_position", "has_value")


@query
def replication_lag(spark, d):
    full = _ledger(spark, d, "address", "revision", "global_position", "user_id")
    return reads.replication_lag(full, views.replica(full, _high(spark, d)))


@query
def tiered_read(spark, d):
    full = _ledger(spark, d, "address", "revision", "global_position", "operation", "user_id")
    return reads.tiered_latest(views.replica(full, _high(spark, d)), full).select("address", "revision", "operation", "tier", "repair")


@query
def change_pairs(spark, d):
    return reads.change_pairs(_ledger(spark, d, "address", "revision", "operation", "value"), ["operation", "value"])


@query
def changes_by_operation(spark, d):
    return reads.change_pairs(_ledger(spark, d, "address", "revision", "operation"), ["operation"]).where("operation = 'Cleared'")


@query
def observe_buffer(spark, d):
    return reads.observe_buffer(_ledger(spark, d, "address", "revision", "operation"), 64)


# --- folds ------------------------------------------------------------------------------------------------------


@query
def revision_numbering(spark, d):
    return writes.revision_numbering(views.raw_records(spark, d).select("address", "event_id"), "event_id")


@query
def last_known_value(spark, d):
    r = views.raw_records(spark, d).select("address", "event_id", "event_type", "value")
    return writes.last_known_value(r, F.col("event_type").isin("view", "click", "purchase"), F.col("event_type") == "signup", "value", "event_id").select("event_id", "last_known")


@query
def conditional_append(spark, d):
    return writes.conditional_append(views.commands(spark, d))


@query
def update_fold(spark, d):
    r = views.raw_records(spark, d).select("address", "event_id", F.floor("value").cast("long").alias("amount"))
    return writes.reduce_commands(r, ["event_id"], F.lit(0).cast("long"), lambda s, c: F.when(c["amount"] % 2 == 0, s + c["amount"]).otherwise(F.greatest(s - c["amount"], F.lit(0).cast("long"))))


@query
def dispatch_fold(spark, d):
    r = views.raw_records(spark, d).select("address", "event_id", "event_type", F.floor("value").cast("long").alias("amount"))
    return writes.dispatch(r, ["event_id"], F.lit(100).cast("long"), lambda s, c: F.when(c["event_type"] == "purchase", s - c["amount"]).otherwise(s + c["amount"]), [lambda s, c: F.when(c["event_type"] == "error", F.lit("no errors")), lambda s, c: F.when((c["event_type"] == "purchase") & (c["amount"] > s), F.lit("too dear"))], lambda s: s <= 400)


@query
def suppress_equivalent(spark, d):
    r = views.raw_records(spark, d).select("address", "event_id", "event_type")
    return writes.suppress_equivalent(r, "event_type", "event_id")


@query
def fault_policy(spark, d):
    r = views.raw_records(spark, d).select("address", "event_id", "event_type", "value")
    known = writes.last_known_value(r, F.col("event_type").isin("view", "click", "purchase"), F.col("event_type") == "signup", "value", "event_id")
    return writes.fault_record(known.where("event_type = 'error'"), True).select("event_id", "value", "has_value", "error_code", "transient")


@query
def import_upsert(spark, d):
    cols = ["address", "revision", "global_position", "operation"]
    r = _ledger(spark, d, *cols, "user_id", "event_id")
    return writes.import_exact(r, views.imports(r), cols)


@query
def stream_revision_fold(spark, d):
    """The feed as a stream of files, folded per address by the state store."""
    e = spark.readStream.schema(views.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return feed.fold_of_files(spark, e.select(F.concat(F.lit("app::users/activity::"), F.col("user_id").cast("string")).alias("address"), (F.col("event_id") + 1).alias("global_position"), views.operation().alias("operation"), "value"))


@query
def position_allocation(spark, d):
    """Positions of the unconditional commands: those that are appended whatever the others do."""
    return writes.allocate_positions(views.commands(spark, d).where("condition = 'Any'").select("seq"), "seq", 5000)


@query
def late_imports(spark, d):
    r = _ledger(spark, d, "address", "revision", "global_position", "operation", "user_id", "event_id")
    return writes.late_imports(views.imports(r), 1_000_500).select("address", "revision", "global_position", "late")


# --- retention --------------------------------------------------------------------------------------------------

_KEPT = ["address", "revision", "global_position", "occurred_at", "operation", "payload_bytes"]


def _pruned(spark, d, **policy):
    return retention.prune(_ledger(spark, d, *_KEPT), retention.Policy(**policy), views.as_of())


@query
def prune_age(spark, d):
    return _pruned(spark, d, age="interval 10 days").select("address", "revision")


@query
def prune_tombstones(spark, d):
    return _pruned(spark, d, keep_tombstones=False).select("address", "revision")


@query
def prune_last_n(spark, d):
    return _pruned(spark, d, max_revisions=7).select("address", "revision")


@query
def prune_bytes(spark, d):
    return _pruned(spark, d, max_bytes=3000).select("address", "revision", "payload_bytes")


@query
def prune_combined(spark, d):
    return _pruned(spark, d, age="interval 20 days", keep_tombstones=False, max_revisions=25, max_bytes=4000).select("address", "revision", "payload_bytes")


@query
def prune_orders(spark, d):
    """Retention over the longest histories: orders by customer."""
    return retention.prune(views.orders_ledger(spark, d), retention.Policy(max_revisions=12, max_bytes=900_000)).select("address", "revision", "payload_bytes")


@query
def feed_after_prune(spark, d):
    return reads.read_feed(_pruned(spark, d, max_revisions=5).select("global_position", "address", "revision"), 100, 500)


# --- composition, routing, maintenance --------------------------------------------------------------------------


def _facets(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.col("lang"), "source", "n_chars")
    base = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.named_struct(F.lit("chars"), F.lit(1).cast("long"), F.lit("note"), F.lit("held"))).alias("state"))
    profile = compose.Source("profile", docs.select("doc_id", F.struct("lang", "n_chars").alias("value")), lambda s, v: F.struct((F.coalesce(s["chars"], F.lit(0)) + v["n_chars"]).cast("long").alias("chars"), F.concat_ws(" ", s["note"], v["lang"]).alias("note")))
    labels = compose.Source("labels", views.table(spark, d, "labels").select("doc_id", F.struct("quality", "toxic").alias("value")), lambda s, v: F.struct((F.coalesce(s["chars"], F.lit(0)) * 2).cast("long").alias("chars"), F.concat_ws(" ", s["note"], F.lit("q"), v["quality"].cast("string")).alias("note")))
    return base, profile, labels


def _composed(rows):
    return rows.select("doc_id", "state.chars", "state.note", "status", "completeness", "error_code", "faulted")


@query
def compose_sequential(spark, d):
    base, profile, labels = _facets(spark, d)
    first = compose.compose(base, "doc_id", "state", [profile], best_effort=True)
    return compose.compose(first.select("doc_id", "state"), "doc_id", "state", [labels], best_effort=True).select("doc_id", "state.chars", "state.note", "status", "error_code")


@query
def compose_parallel(spark, d):
    base, profile, labels = _facets(spark, d)
    return _composed(compose.compose(base, "doc_id", "state", [labels, profile], best_effort=True))


@query
def compose_require_all(spark, d):
    base, profile, labels = _facets(spark, d)
    return _composed(compose.compose(base, "doc_id", "state", [profile, labels]))


@query
def compose_best_effort(spark, d):
    base, _, labels = _facets(spark, d)
    toxic = compose.Source("toxic", labels.rows.where("value.toxic = 1"), labels.apply)
    initial = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit(7).cast("long").alias("chars"), F.lit("new").alias("note")))
    return _composed(compose.compose(base, "doc_id", "state", [labels, toxic], best_effort=True, initial=initial))


@query
def load_completeness(spark, d):
    base, profile, labels = _facets(spark, d)
    c = compose.compose(base, "doc_id", "state", [profile, labels], best_effort=True)
    c = c.withColumn("labels_status", compose.load_metadata(["profile", "labels"], F.col("faulted"))["source.labels.status"])
    return c.groupBy("completeness", "labels_status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_faulted").cast("long").alias("faulted"))


@query
def refresh_coalesce(spark, d):
    e = views.raw_records(spark, d)
    return compose.refresh_requests(e.select("address", F.floor(F.col("event_id") / 200).alias("batch"), F.col("event_id").alias("seq"), F.col("event_type").alias("source")))


STATES = [("users/activity", True, ["User.Changed", "reset"], True, ["3", "1", "3"]), ("users/profile", False, ["USER.changed"], True, []), ("flags", False, ["Reset"], False, []), ("reports/daily", True, ["nightly"], True, [])]
STATE_KIND = "path string, partitioned boolean, signals array<string>, warm_on_start boolean, warm_partitions array<string>"


@query
def signal_targets(spark, d):
    key = F.col("s_suppkey")
    name = F.when(key % 2 == 0, "user.Changed").when(key % 5 == 0, "nothing").otherwise("RESET")
    partition = F.when(key % 3 == 1, F.lit("default")).when(key % 3 == 2, key.cast("string"))
    signals = views.table(spark, d, "supplier").select(key.alias("signal_id"), name.alias("name"), partition.alias("partition"), F.when(key % 4 == 0, "users").otherwise("").alias("scope"))
    handles = views.table(spark, d, "events").select(F.lit("users/activity").alias("path"), F.col("user_id").cast("string").alias("partition")).distinct()
    return routing.signal_targets(signals, spark.createDataFrame(STATES, STATE_KIND), handles)


@query
def warm_targets(spark, d):
    """Of the declared states alone: warm partitions are part of a manifest, not of a table."""
    return routing.warm_targets(spark.createDataFrame(STATES, STATE_KIND))


@query
def maintenance_due(spark, d):
    heads = reads.read_latest(_ledger(spark, d, "address", "revision", "occurred_at", "user_id"))
    return routing.maintenance_due(heads, views.as_of(), F.expr("interval 36 hours")).groupBy((F.col("user_id") % 3).alias("store")).agg(F.count(F.lit(1)).alias("due"))


@query
def duplicate_declarations(spark, d):
    p = views.table(spark, d, "part")
    return routing.duplicate_declarations(p.select(F.lit("source").alias("kind"), F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")), F.lit(" "), "p_type").alias("name")))


# --- diagnostics ------------------------------------------------------------------------------------------------


def _reports(spark, d):
    c = views.table(spark, d, "conversations")
    return c.select(F.concat(F.lit("app::conversations::"), F.col("conv_id").cast("string")).alias("address"), F.col("role").alias("source"), F.length("text").cast("long").alias("elapsed"), F.col("turn").cast("long").alias("completed"), (F.length("text") % 4 != 0).alias("complete"))


@query
def load_report_retention(spark, d):
    return diagnostics.latest_reports(_reports(spark, d))


@query
def health_rollup(spark, d):
    return diagnostics.health(_reports(spark, d))


@query
def telemetry_rollup(spark, d):
    return diagnostics.telemetry(_ledger(spark, d, "root", "path", "operation", "source", "payload_bytes"), ["root", "path", "operation", "source"], "payload_bytes")


@query
def telemetry_histogram(spark, d):
    return diagnostics.histogram(_reports(spark, d), ["source"], "elapsed")


@query
def failure_rate_limit(spark, d):
    e = views.table(spark, d, "events").where("event_type = 'error'")
    f = e.select((F.col("user_id") % 3).alias("store"), F.floor(F.col("event_id") / 10).cast("long").alias("second"), "event_id")
    return diagnostics.anchored_rate_limit(f, "store", "second", "event_id")


# --- integrity --------------------------------------------------------------------------------------------------


def _layout(spark, d):
    r = _ledger(spark, d, "address", "partition", "revision", "global_position", "event_id")
    history = r.where("event_id % 19 <> 0").select("address", "revision", "global_position", (F.col("event_id") % 23 != 0).alias("readable"))
    heads = reads.read_latest(r.select("address", "revision", "global_position")).where("global_position % 5 <> 0").select("address", "revision")
    line = F.concat_ws("\t", (F.col("global_position") + F.when(F.col("event_id") % 29 == 0, 1).otherwise(0)).cast("string"), F.lit("App"), F.lit("users/activity"), "partition", F.col("revision").cast("string"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 31 == 0, 1).otherwise(0)))
    lines = r.where("event_id % 37 <> 0").select("event_id", line.alias("text"), copies.alias("copy"))
    lines = lines.select((F.col("event_id") * 2 + F.col("copy")).alias("line_no"), "text", F.lit(False).alias("last"))
    torn = spark.createDataFrame([(1 << 40, "12\tApp\tusers/", True)], "line_no long, text string, last boolean")
    return heads, history, integrity.parse_log(lines.unionByName(torn))


@query
def verify_findings(spark, d):
    heads, history, log = _layout(spark, d)
    bad = views.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(((F.col("s_suppkey") + (1 << 41)).cast("long")).alias("line_no"), F.lit("x\tApp").alias("text"), F.lit(False).alias("last"))
    r = _ledger(spark, d, "address", "partition", "revision", "event_id")
    place = identity.history_file(F.col("address"), F.col("revision"))
    wrong = F.concat(F.lit("ff/ff"), F.lpad("partition", 62, "0"), F.lit("/history/1.json"))
    files = r.select(F.when(F.col("event_id") % 41 == 0, F.concat(place, F.lit(".7.tmp"))).when(F.col("event_id") % 43 == 0, wrong).otherwise(place).alias("path"), F.when(F.col("event_id") % 41 != 0, F.col("address")).alias("address"))
    return integrity.verify(heads, history, log.unionByName(integrity.parse_log(bad)), files)


@query
def compact_log(spark, d):
    _, history, log = _layout(spark, d)
    return integrity.compact(log, history).select("line_no", "reason")


@query
def compaction_report(spark, d):
    _, history, log = _layout(spark, d)
    return integrity.compaction_report(integrity.compact(log, history))


@query
def repair_plan(spark, d):
    heads, history, _ = _layout(spark, d)
    return integrity.repair_plan(heads, history)


# --- export and delivery ----------------------------------------------------------------------------------------

_EXPORTED = ["address", "revision", "global_position", "operation", "status", "value", "has_value", "schema_version"]


@query
def export_records(spark, d):
    return export_lines(_ledger(spark, d, *_EXPORTED))


@query
def export_restore_roundtrip(spark, d):
    return parse_export(export_lines(_ledger(spark, d, *_EXPORTED)).select("line"))


@query
def fixture_capture(spark, d):
    s = freshness.snapshot(reads.read_latest(_ledger(spark, d, *HEAD, "partition")), views.as_of())
    return s.select("partition", "status", "has_value", F.when(F.col("has_value"), F.to_json(F.struct(F.floor("value").cast("long").alias("v")))).alias("value_json"))


@query
def outbox_messages(spark, d):
    return rec.message(_ledger(spark, d, "address", "revision", "global_position", "operation", "status", "value", "has_value"), "main")


@query
def outbox_dedupe(spark, d):
    m = rec.message(_ledger(spark, d, "address", "revision", "global_position", "operation", "status", "value", "has_value"), "main").select("global_position", "message_id")
    before = m.where("global_position % 3 = 0").select("global_position", F.when(F.col("global_position") % 9 == 0, F.concat("message_id", F.lit("x"))).otherwise(F.col("message_id")).alias("message_id"))
    return outbox.conflicts_and_new(m, before).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def outbox_cursor(spark, d):
    e = views.raw_records(spark, d)
    consumer = F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("consumer")
    stored = e.where("event_type = 'view'").select(consumer, F.col("global_position").alias("position"))
    return outbox.advance_cursor(stored, e.where("event_type <> 'view'").select(consumer, F.col("global_position").alias("position")))


@query
def outbox_batches(spark, d):
    return outbox.batches(reads.feed_pages(views.raw_records(spark, d).select("global_position", "address"), 128), 128)


@query
def backoff_schedule(spark, d):
    """Of attempts 0 to 63: a schedule is a function of the attempt, not of a table."""
    return spark.range(0, 64).select(F.col("id").alias("attempt"), outbox.backoff(F.col("id"), 1000, 60000).alias("delay_ms"))


@query
def outbox_poison_skip(spark, d):
    failures = views.raw_records(spark, d).where("event_type = 'error'").groupBy(F.floor(F.col("event_id") / 100).alias("batch")).agg(F.count(F.lit(1)).alias("attempts"))
    return failures.withColumn("skipped", outbox.poison(F.col("attempts"), 12))
