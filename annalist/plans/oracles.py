"""The queries of queries.py in DuckDB SQL, written from the operators' definitions, not from Spark's plans."""

LEDGER = """
op AS (
  SELECT event_id, user_id, ts, value AS given, props,
    CASE event_type WHEN 'view' THEN 'Refreshed' WHEN 'click' THEN 'Transitioned' WHEN 'purchase' THEN 'Set' WHEN 'signup' THEN 'Cleared'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'Faulted' ELSE 'Invalidated' END END AS operation
  FROM events),
ep AS (
  SELECT *, row_number() OVER w AS revision, sum(CASE WHEN operation = 'Cleared' THEN 1 ELSE 0 END) OVER w AS epoch,
    operation IN ('Refreshed', 'Transitioned', 'Set') AS ready
  FROM op WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
held AS (
  SELECT *, last_value(CASE WHEN ready THEN given END IGNORE NULLS) OVER e AS v,
    last_value(CASE WHEN ready THEN length(props) * CAST(ceil(given) AS BIGINT) END IGNORE NULLS) OVER e AS b,
    last_value(CASE WHEN ready THEN ts + INTERVAL 30 HOUR END IGNORE NULLS) OVER u AS last_serve
  FROM ep WINDOW e AS (PARTITION BY user_id, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
ledger AS (
  SELECT 'app' AS root, 'users/activity' AS path, CAST(user_id AS VARCHAR) AS partition, 'app::users/activity::' || user_id AS address,
    event_id + 1 AS global_position, revision, ts AS occurred_at, operation, CASE WHEN ready THEN 'Ready' ELSE operation END AS status,
    CASE WHEN operation <> 'Cleared' THEN v END AS value, CASE WHEN operation <> 'Cleared' THEN coalesce(b, 0) ELSE 0 END AS payload_bytes,
    operation <> 'Cleared' AND v IS NOT NULL AS has_value,
    CASE WHEN ready THEN ts + INTERVAL 6 HOUR ELSE ts END AS fresh_until,
    CASE WHEN ready THEN ts + INTERVAL 30 HOUR ELSE greatest(ts, coalesce(last_serve, ts)) END AS serve_until,
    CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS schema_version,
    CASE WHEN operation IN ('Refreshed', 'Faulted') THEN 'loader' WHEN operation = 'Transitioned' THEN 'interaction' ELSE 'application' END AS source,
    'double' AS value_type, props, user_id, event_id
  FROM held),
clock AS (SELECT TIMESTAMP '2024-01-31 00:00:00' AS t),
head AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY address ORDER BY revision DESC) = 1),
snap_all AS (
  SELECT ledger.* EXCLUDE (status), has_value AND t <= fresh_until AS is_fresh, has_value AND NOT t <= fresh_until AS is_stale, has_value AND t <= serve_until AS can_serve,
    CASE WHEN status IN ('Ready', 'Stale') AND has_value THEN CASE WHEN t > fresh_until THEN 'Stale' ELSE 'Ready' END ELSE status END AS status
  FROM ledger, clock),
snap AS (SELECT s.* FROM snap_all s JOIN head USING (address, revision)),
hot AS (SELECT * FROM ledger WHERE global_position <= floor((SELECT max(event_id) + 1 FROM events) * 0.8) AND user_id % 7 <> 0)
"""

_ADDRESS = "'app::users/activity::' || user_id"
ORACLES: dict[str, str] = {}


def _of_ledger(**sql: str) -> None:
    ORACLES.update({k: f"WITH RECURSIVE {LEDGER}{v if v.lstrip().startswith(',') else ' ' + v}" for k, v in sql.items()})


_of_ledger(
    address_digest="SELECT address, revision, sha256(address) AS digest, substr(sha256(address), 1, 2) || '/' || sha256(address) || '/history/' || lpad(CAST(revision AS VARCHAR), 20, '0') || '.json' AS file FROM ledger",
    record_validation="""SELECT global_position, concat_ws(',',
        CASE WHEN event_id % 11 = 0 THEN 'value_type' END,
        CASE WHEN status IN ('Ready', 'Stale') AND NOT (has_value <> (event_id % 17 = 0)) THEN 'payload_required' END,
        CASE WHEN status = 'Cleared' AND (has_value <> (event_id % 17 = 0)) THEN 'payload_forbidden' END,
        CASE WHEN event_id % 13 = 0 THEN 'serve_window' END) AS violations FROM ledger""",
    snapshot_asof="SELECT address, revision, status, value, is_fresh, is_stale, can_serve FROM snap",
    freshness_counts="SELECT operation, status, is_fresh, is_stale, count(*) AS n FROM snap_all GROUP BY ALL",
    read_mode_decisions="""SELECT address, mode, status,
        CASE mode WHEN 'Cached' THEN false WHEN 'Fresh' THEN NOT is_fresh OR status IN ('Invalidated', 'Faulted')
          WHEN 'RefreshIfStale' THEN status IN ('Absent', 'Cleared', 'Stale', 'Invalidated', 'Faulted')
          ELSE status IN ('Absent', 'Stale', 'Invalidated', 'Faulted') END AS needs_refresh,
        mode = 'Current' AND has_value AND status IN ('Absent', 'Stale', 'Invalidated', 'Faulted') AS in_background,
        CASE WHEN mode = 'Fresh' THEN (is_fresh AND status = 'Ready') OR (status = 'Faulted' AND has_value) ELSE has_value END AS served
      FROM snap, (VALUES ('Cached'), ('Current'), ('RefreshIfStale'), ('Fresh')) m(mode)""",
    schema_migration="SELECT global_position, CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS k10, CASE schema_version WHEN 1 THEN 'migrated' ELSE 'current' END AS origin FROM ledger",
    invariant_violations="SELECT global_position, CASE WHEN value >= 90 THEN 'bounded' ELSE 'sized' END AS violated FROM ledger WHERE has_value AND (value >= 90 OR payload_bytes <= 0)",
    read_latest="SELECT address, revision, global_position, occurred_at, operation, value FROM head",
    history_newest="SELECT address, revision, operation, global_position FROM ledger QUALIFY row_number() OVER (PARTITION BY address ORDER BY revision DESC) <= 20",
    history_since_before="SELECT address, revision, operation FROM ledger WHERE revision < 50 AND occurred_at >= TIMESTAMP '2024-01-05' QUALIFY row_number() OVER (PARTITION BY address ORDER BY revision) <= 10",
    history_snapshots="SELECT address, revision, status, is_fresh, is_stale, can_serve FROM snap_all QUALIFY row_number() OVER (PARTITION BY address ORDER BY revision DESC) <= 5",
    endpoint_history="SELECT address, revision, operation, CAST(NULL AS DOUBLE) AS value FROM ledger WHERE address = 'app::users/activity::7' ORDER BY revision DESC LIMIT 100",
    partition_catalog="SELECT address, global_position AS last_position, revision AS last_revision FROM head",
    capture_process_local=""", refs AS (SELECT DISTINCT 'app::users/activity::' || user_id AS address FROM events UNION SELECT 'app::absent::' || s_suppkey FROM supplier)
      SELECT coalesce(max(global_position), 0) AS capture_position, count(*) AS states, count(*) FILTER (head.address IS NULL) AS absent FROM refs LEFT JOIN head USING (address)""",
    capture_at_position=""", past AS (SELECT * FROM ledger WHERE global_position <= 600 QUALIFY row_number() OVER (PARTITION BY address ORDER BY revision DESC) = 1)
      SELECT a.address, coalesce(status, 'Absent') AS status, coalesce(revision, 0) AS revision, coalesce(global_position, 0) AS global_position, coalesce(has_value, false) AS has_value
      FROM (SELECT DISTINCT address FROM ledger) a LEFT JOIN past USING (address)""",
    replication_lag=""", hh AS (SELECT address, max(global_position) AS r FROM hot GROUP BY 1)
      SELECT max(global_position) AS authority_position, coalesce(max(r), 0) AS replica_position, count(*) FILTER (r IS NULL OR r < global_position) AS partitions_behind,
        greatest(0, max(global_position) - coalesce(max(r), 0)) AS gap, bool_and(r IS NOT NULL AND r >= global_position) AND max(global_position) <= coalesce(max(r), 0) AS caught_up
      FROM head LEFT JOIN hh USING (address)""",
    tiered_read=""", hl AS (SELECT * FROM hot QUALIFY row_number() OVER (PARTITION BY address ORDER BY revision DESC) = 1)
      SELECT c.address, coalesce(h.revision, c.revision) AS revision, coalesce(h.operation, c.operation) AS operation, CASE WHEN h.address IS NULL THEN 'cold' ELSE 'hot' END AS tier, h.address IS NULL AS repair
      FROM head c LEFT JOIN hl h USING (address)""",
    change_pairs="SELECT address, revision, operation, value, lag(operation) OVER w AS previous_operation, lag(value) OVER w AS previous_value FROM ledger WINDOW w AS (PARTITION BY address ORDER BY revision)",
    changes_by_operation="SELECT address, revision, operation, lag(operation) OVER (PARTITION BY address ORDER BY revision) AS previous_operation FROM ledger QUALIFY operation = 'Cleared'",
    observe_buffer="SELECT address, revision, operation FROM ledger QUALIFY row_number() OVER (PARTITION BY address ORDER BY revision DESC) <= 64",
    last_known_value="SELECT event_id, value AS last_known FROM ledger",
    fault_policy="""SELECT event_id, value, value IS NOT NULL AS has_value, 'loader-failed' AS error_code, true AS transient FROM ledger WHERE operation IN ('Faulted', 'Invalidated')""",
    import_upsert="""SELECT address, revision, CASE WHEN user_id % 5 = 0 AND revision <= 3 THEN 1000000 + event_id ELSE global_position END AS global_position,
        CASE WHEN user_id % 5 = 0 AND revision <= 3 THEN 'Imported' ELSE operation END AS operation, user_id % 5 = 0 AND revision <= 3 AS imported FROM ledger""",
    late_imports="SELECT address, revision, 1000000 + event_id AS global_position, 1000000 + event_id <= 1000500 AS late FROM ledger WHERE user_id % 5 = 0 AND revision <= 3",
    prune_age="SELECT l.address, l.revision FROM ledger l JOIN head h USING (address) WHERE l.occurred_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY OR l.revision = h.revision",
    prune_tombstones="SELECT l.address, l.revision FROM ledger l JOIN head h USING (address) WHERE l.operation <> 'Cleared' OR l.revision = h.revision",
    prune_last_n="SELECT address, revision FROM ledger QUALIFY row_number() OVER (PARTITION BY address ORDER BY revision DESC) <= 7",
    prune_bytes=""", s AS (SELECT address, revision, payload_bytes, row_number() OVER (PARTITION BY address ORDER BY revision DESC) AS n FROM ledger),
      g AS (SELECT address, n, revision, payload_bytes, payload_bytes AS total, true AS kept FROM s WHERE n = 1
        UNION ALL SELECT s.address, s.n, s.revision, s.payload_bytes, CASE WHEN g.total + s.payload_bytes <= 3000 THEN g.total + s.payload_bytes ELSE g.total END, g.total + s.payload_bytes <= 3000 FROM g JOIN s ON s.address = g.address AND s.n = g.n + 1)
      SELECT address, revision, payload_bytes FROM g WHERE kept""",
    prune_combined=""", a AS (SELECT l.* FROM ledger l JOIN (SELECT address, revision AS top FROM head) h USING (address) WHERE (l.occurred_at >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY AND l.operation <> 'Cleared') OR l.revision = top),
      s AS (SELECT address, revision, payload_bytes, row_number() OVER (PARTITION BY address ORDER BY revision DESC) AS n FROM a QUALIFY n <= 25),
      g AS (SELECT address, n, revision, payload_bytes, payload_bytes AS total, true AS kept FROM s WHERE n = 1
        UNION ALL SELECT s.address, s.n, s.revision, s.payload_bytes, CASE WHEN g.total + s.payload_bytes <= 4000 THEN g.total + s.payload_bytes ELSE g.total END, g.total + s.payload_bytes <= 4000 FROM g JOIN s ON s.address = g.address AND s.n = g.n + 1)
      SELECT address, revision, payload_bytes FROM g WHERE kept""",
    feed_after_prune="""SELECT global_position, address, revision FROM (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY address ORDER BY revision DESC) <= 5) WHERE global_position > 100 ORDER BY global_position, address, revision LIMIT 500""",
    maintenance_due="SELECT user_id % 3 AS store, count(*) AS due FROM head WHERE occurred_at + INTERVAL 36 HOUR <= TIMESTAMP '2024-01-31' GROUP BY 1",
    telemetry_rollup="SELECT root, path, operation, source, count(*) AS n, CAST(sum(payload_bytes) AS BIGINT) AS total, min(payload_bytes) AS least, max(payload_bytes) AS most FROM ledger GROUP BY ALL",
    export_records="""SELECT address, revision, '{"address":"' || address || '","revision":' || revision || ',"globalPosition":' || global_position || ',"operation":"' || operation || '","status":"' || status || '","schemaVersion":' || schema_version
        || CASE WHEN has_value THEN ',"payload":"' || to_base64(encode(CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR))) || '"' ELSE '' END || '}' AS line FROM ledger""",
    export_restore_roundtrip="SELECT address, revision, global_position, operation, status, schema_version, CASE WHEN has_value THEN CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR) END AS payload FROM ledger",
    fixture_capture="""SELECT partition, status, has_value, CASE WHEN has_value THEN '{"v":' || CAST(floor(value) AS BIGINT) || '}' END AS value_json FROM snap""",
    outbox_messages="""SELECT 'main/' || address || '#' || revision AS message_id, address, revision, global_position, operation, status, CASE WHEN has_value THEN 'application/json' END AS content_type,
        CASE WHEN has_value THEN sha256(CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR)) END AS fingerprint FROM ledger""",
    outbox_dedupe="SELECT CASE WHEN global_position % 9 = 0 THEN 'conflict' WHEN global_position % 3 = 0 THEN 'duplicate' ELSE 'new' END AS outcome, count(*) AS n FROM ledger GROUP BY 1",
)

_LAYOUT = """,
hist AS (SELECT address, revision, global_position, event_id % 23 <> 0 AS readable FROM ledger WHERE event_id % 19 <> 0),
hd AS (SELECT address, revision FROM head WHERE global_position % 5 <> 0),
logs AS (SELECT event_id * 2 + c AS line_no, global_position + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS global_position, address, revision,
    octet_length(encode(CAST(global_position + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS VARCHAR) || ' App users/activity ' || partition || ' ' || revision)) + 1 AS bytes
  FROM ledger, (VALUES (0), (1)) x(c) WHERE event_id % 37 <> 0 AND (c = 0 OR event_id % 31 = 0)),
judged AS (SELECT l.*, h.readable, h.global_position AS hp,
    CASE WHEN h.readable IS NULL THEN 'dangling' WHEN h.readable AND l.global_position <> h.global_position THEN 'mismatch'
      WHEN row_number() OVER (PARTITION BY l.address, l.revision, l.global_position ORDER BY line_no) > 1 THEN 'duplicate' ELSE 'keep' END AS reason
  FROM logs l LEFT JOIN hist h ON h.address = l.address AND h.revision = l.revision)
"""
_of_ledger(stream_revision_fold="SELECT address, global_position, revision, value FROM ledger")
_of_ledger(
    verify_findings=_LAYOUT
    + """SELECT 'DanglingChangeLogLine' AS kind, address, revision FROM judged WHERE readable IS NULL
      UNION ALL SELECT 'ChangeLogPositionMismatch', address, revision FROM judged WHERE readable AND global_position <> hp
      UNION ALL SELECT 'UnreadableRecordFile', address, revision FROM hist WHERE NOT readable
      UNION ALL SELECT 'MissingHead', address, max(revision) FROM hist WHERE address NOT IN (SELECT address FROM hd) GROUP BY address
      UNION ALL SELECT 'MissingHistoryFile', address, revision FROM hd WHERE (address, revision) NOT IN (SELECT (address, revision) FROM hist)
      UNION ALL SELECT 'TornChangeLogTail', NULL, 1099511627776
      UNION ALL SELECT 'MalformedChangeLogLine', NULL, s_suppkey + 2199023255552 FROM supplier WHERE s_suppkey % 3 = 0
      UNION ALL SELECT 'OrphanedTemporaryFile', NULL, NULL FROM events WHERE event_id % 41 = 0
      UNION ALL SELECT DISTINCT 'MisplacedStreamDirectory', 'app::users/activity::' || user_id, CAST(NULL AS BIGINT) FROM events WHERE event_id % 43 = 0 AND event_id % 41 <> 0""",
    compact_log=_LAYOUT + "SELECT line_no, reason FROM judged UNION ALL SELECT 1099511627776, 'torn'",
    compaction_report=_LAYOUT + "SELECT reason, count(*) AS lines, CAST(sum(bytes) AS BIGINT) AS bytes FROM judged GROUP BY 1 UNION ALL SELECT 'torn', 1, 14",
    repair_plan=_LAYOUT
    + """, good AS (SELECT address, max(revision) AS newest FROM hist WHERE readable GROUP BY 1)
      SELECT 'quarantine' AS action, address, revision FROM hist WHERE NOT readable
      UNION ALL SELECT 'rewrite-head', g.address, newest FROM good g LEFT JOIN hd USING (address) WHERE hd.revision IS NULL OR hd.revision < newest
      UNION ALL SELECT 'restore-history', address, revision FROM hd WHERE (address, revision) NOT IN (SELECT (address, revision) FROM hist WHERE readable)""",
)

_LOADS = """WITH b AS (SELECT d.doc_id, lang, n_chars, quality, toxic, l.doc_id IS NOT NULL AS labelled,
    CASE WHEN d.doc_id % 5 = 0 THEN 1 END AS c0, CASE WHEN d.doc_id % 5 = 0 THEN 'held' END AS n0 FROM documents d LEFT JOIN labels l USING (doc_id))"""

ORACLES |= {
    "telemetry_histogram": """SELECT source, bucket, n, ([0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000])[bucket + 1] AS upper
      FROM (SELECT role AS source, len([b FOR b IN [0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000] IF b < length(text)]) AS bucket, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY ALL)""",
    "path_normalize": r"""SELECT page_id, regexp_replace(regexp_replace(lower(replace(trim(replace(url, '://', '\\') || '//A/', ' '), '\', '/')), '/+', '/', 'g'), '^/|/$', '', 'g') AS path, true AS valid,
      CASE WHEN page_id % 3 = 1 THEN 'Ab' ELSE 'default' END AS partition FROM pages""",
    "canonical_address": "SELECT c_custkey, 'app::customers/' || lower(c_mktsegment) || '::' || c_custkey AS address FROM customer",
    "container_scope": """SELECT p_partkey, path, path <> '' AS in_0, starts_with(path, 'parts/') AS in_1, starts_with(path, 'parts/brand#11/') AS in_2, starts_with(path, 'parts/brand#1/') AS in_3
      FROM (SELECT p_partkey, 'parts/' || lower(p_brand) || '/' || lower(p_type) AS path FROM part)""",
    "source_status_key": r"SELECT conv_id, turn, regexp_replace(lower(role || ' Läuft/' || turn || '#x-1.y'), '[^\p{L}\p{N}._-]', '_', 'g') AS key FROM conversations",
    "container_parent": """WITH p AS (SELECT DISTINCT 'parts/' || lower(p_brand) || '/' || lower(p_type) AS path FROM part), c AS (SELECT DISTINCT 'parts/' || lower(p_brand) AS c FROM part WHERE p_size > 25 UNION SELECT 'parts')
      SELECT path, coalesce(arg_max(c, length(c)), '') AS parent FROM p LEFT JOIN c ON starts_with(path, c || '/') GROUP BY path""",
    "feed_page": f"SELECT event_id + 1 AS global_position, {_ADDRESS} AS address, event_type FROM events WHERE event_id + 1 > 500 ORDER BY event_id LIMIT 250",
    "feed_pages": "SELECT event_id + 1 AS global_position, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 100) AS BIGINT) AS page FROM events WHERE event_id + 1 > 50",
    "revision_numbering": f"SELECT {_ADDRESS} AS address, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision FROM events",
    "conditional_append": f"""WITH RECURSIVE c AS (SELECT user_id, event_id, event_id % 4 AS k, 1 + event_id % 7 AS want, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      f AS (SELECT user_id, event_id, n, k IN (0, 1, 3) AS ok, CASE WHEN k = 2 THEN 0 ELSE 1 END AS rev FROM c WHERE n = 1
        UNION ALL SELECT c.user_id, c.event_id, c.n, CASE k WHEN 1 THEN f.rev = 0 WHEN 2 THEN f.rev = want ELSE true END,
          f.rev + CASE WHEN CASE k WHEN 1 THEN f.rev = 0 WHEN 2 THEN f.rev = want ELSE true END THEN 1 ELSE 0 END FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1)
      SELECT {_ADDRESS} AS address, event_id AS seq, CASE WHEN ok THEN 'appended' ELSE 'conflict' END AS outcome, CAST(rev AS BIGINT) AS revision FROM f""",
    "update_fold": f"""WITH RECURSIVE c AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT c.user_id, c.n, CASE WHEN a % 2 = 0 THEN s + a ELSE greatest(s - a, 0) END FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1)
      SELECT {_ADDRESS} AS address, arg_max(s, n) AS state FROM f GROUP BY user_id""",
    "dispatch_fold": f"""WITH RECURSIVE c AS (SELECT user_id, event_type AS e, CAST(floor(value) AS BIGINT) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(100 AS BIGINT) AS s, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS broken FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT user_id, n, CASE WHEN refused OR new > 400 THEN s ELSE new END, accepted + CASE WHEN refused OR new > 400 THEN 0 ELSE 1 END, rejected + CASE WHEN refused THEN 1 ELSE 0 END, broken + CASE WHEN NOT refused AND new > 400 THEN 1 ELSE 0 END
          FROM (SELECT c.user_id, c.n, f.s, accepted, rejected, broken, e = 'error' OR (e = 'purchase' AND a > s) AS refused, CASE WHEN e = 'purchase' THEN s - a ELSE s + a END AS new FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1))
      SELECT {_ADDRESS} AS address, s AS state, accepted, rejected, broken FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
    "suppress_equivalent": f"SELECT address, event_id, event_type FROM (SELECT {_ADDRESS} AS address, event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM p",
    "position_allocation": "SELECT event_id AS seq, 5000 + row_number() OVER (ORDER BY event_id) AS position FROM events WHERE event_id % 4 IN (0, 3)",
    "prune_orders": """WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision, CAST(floor(o_totalprice) AS BIGINT) AS payload_bytes FROM orders),
      s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY revision DESC) AS n FROM o QUALIFY n <= 12),
      g AS (SELECT o_custkey, n, revision, payload_bytes, payload_bytes AS total, true AS kept FROM s WHERE n = 1
        UNION ALL SELECT s.o_custkey, s.n, s.revision, s.payload_bytes, CASE WHEN g.total + s.payload_bytes <= 900000 THEN g.total + s.payload_bytes ELSE g.total END, g.total + s.payload_bytes <= 900000 FROM g JOIN s ON s.o_custkey = g.o_custkey AND s.n = g.n + 1)
      SELECT 'app::customers/orders::' || o_custkey AS address, revision, payload_bytes FROM g WHERE kept""",
    "compose_sequential": _LOADS + """, p AS (SELECT *, coalesce(c0, 0) + n_chars AS c1, concat_ws(' ', n0, lang) AS n1 FROM b)
      SELECT doc_id, CASE WHEN labelled THEN c1 * 2 ELSE c1 END AS chars, CASE WHEN labelled THEN n1 || ' q ' || quality ELSE n1 END AS note, CASE WHEN labelled THEN 'Ready' ELSE 'Faulted' END AS status, CASE WHEN labelled THEN NULL ELSE 'loader-failed' END AS error_code FROM p""",
    "compose_parallel": _LOADS + """, p AS (SELECT *, CASE WHEN labelled THEN coalesce(c0, 0) * 2 ELSE c0 END AS c1, CASE WHEN labelled THEN concat_ws(' ', n0, 'q', quality) ELSE n0 END AS n1 FROM b)
      SELECT doc_id, CAST(coalesce(c1, 0) + n_chars AS BIGINT) AS chars, concat_ws(' ', n1, lang) AS note, 'Ready' AS status, CASE WHEN labelled THEN 'complete' ELSE 'partial' END AS completeness,
        CASE WHEN labelled THEN NULL ELSE 'partial-load' END AS error_code, CASE WHEN labelled THEN '' ELSE 'labels' END AS faulted FROM p""",
    "compose_require_all": _LOADS + """SELECT doc_id, CAST(CASE WHEN labelled THEN (coalesce(c0, 0) + n_chars) * 2 ELSE c0 END AS BIGINT) AS chars, CASE WHEN labelled THEN concat_ws(' ', n0, lang, 'q', quality) ELSE n0 END AS note,
      CASE WHEN labelled THEN 'Ready' ELSE 'Faulted' END AS status, CASE WHEN labelled THEN 'complete' END AS completeness, CASE WHEN labelled THEN NULL ELSE 'loader-failed' END AS error_code, CASE WHEN labelled THEN '' ELSE 'labels' END AS faulted FROM b""",
    "compose_best_effort": _LOADS + """, i AS (SELECT *, labelled AND toxic = 1 AS twice, c0 IS NULL AND doc_id % 2 = 0 AS seeded, coalesce(c0, CASE WHEN doc_id % 2 = 0 THEN 7 END) AS c1, coalesce(n0, CASE WHEN doc_id % 2 = 0 THEN 'new' END) AS n1 FROM b)
      SELECT doc_id, CAST(CASE WHEN twice THEN coalesce(c1, 0) * 4 WHEN labelled THEN coalesce(c1, 0) * 2 WHEN seeded THEN c1 ELSE c0 END AS BIGINT) AS chars,
        CASE WHEN twice THEN concat_ws(' ', n1, 'q', quality, 'q', quality) WHEN labelled THEN concat_ws(' ', n1, 'q', quality) WHEN seeded THEN n1 ELSE n0 END AS note,
        CASE WHEN labelled OR seeded THEN 'Ready' ELSE 'Faulted' END AS status, CASE WHEN twice THEN 'complete' WHEN labelled THEN 'partial' WHEN seeded THEN 'initial-fallback' END AS completeness,
        CASE WHEN twice THEN NULL WHEN labelled OR seeded THEN 'partial-load' ELSE 'loader-failed' END AS error_code, CASE WHEN twice THEN '' WHEN labelled THEN 'toxic' ELSE 'labels, toxic' END AS faulted FROM i""",
    "load_completeness": _LOADS + "SELECT CASE WHEN labelled THEN 'complete' ELSE 'partial' END AS completeness, CASE WHEN labelled THEN 'ready' ELSE 'faulted' END AS labels_status, count(*) AS n, count(*) FILTER (NOT labelled) AS faulted FROM b GROUP BY 1, 2",
    "refresh_coalesce": f"SELECT {_ADDRESS} AS address, CAST(floor(event_id / 200) AS BIGINT) AS batch, arg_min(event_type, event_id) AS source, count(*) AS coalesced FROM events GROUP BY 1, 2",
    "signal_targets": """WITH s AS (SELECT s_suppkey AS signal_id, CASE WHEN s_suppkey % 2 = 0 THEN 'user.changed' WHEN s_suppkey % 5 = 0 THEN 'nothing' ELSE 'reset' END AS name,
        CASE s_suppkey % 3 WHEN 1 THEN 'default' WHEN 2 THEN CAST(s_suppkey AS VARCHAR) END AS part, CASE WHEN s_suppkey % 4 = 0 THEN 'users' ELSE '' END AS scope FROM supplier),
      st(path, partitioned, name) AS (VALUES ('users/activity', true, 'user.changed'), ('users/activity', true, 'reset'), ('users/profile', false, 'user.changed'), ('flags', false, 'reset'), ('reports/daily', true, 'nightly')),
      j AS (SELECT * FROM s JOIN st USING (name) WHERE scope = '' OR starts_with(path, scope || '/'))
      SELECT DISTINCT signal_id, path, part AS partition FROM j WHERE part IS NOT NULL AND (partitioned OR part = 'default')
      UNION SELECT signal_id, path, 'default' FROM j WHERE part IS NULL AND NOT partitioned
      UNION SELECT signal_id, path, CAST(user_id AS VARCHAR) FROM j, (SELECT DISTINCT user_id FROM events) WHERE part IS NULL AND partitioned AND path = 'users/activity'""",
    "warm_targets": "SELECT * FROM (VALUES ('users/activity', '1'), ('users/activity', '3'), ('users/profile', 'default'), ('reports/daily', 'default')) t(path, partition)",
    "duplicate_declarations": "SELECT 'source' AS kind, lower(p_brand || ' ' || CASE WHEN true THEN p_type END) AS name, count(*) AS declared FROM part GROUP BY 1, 2 HAVING count(*) > 1",
    "load_report_retention": """SELECT address, source, elapsed, completed FROM (SELECT 'app::conversations::' || conv_id AS address, role AS source, length(text) AS elapsed, turn AS completed FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1) ORDER BY completed DESC, address DESC LIMIT 64""",
    "health_rollup": """SELECT count(*) AS loads, count(*) FILTER (length(text) % 4 = 0) AS incomplete, CAST(sum(length(text)) AS BIGINT) AS elapsed, max((length(text), role))[2] AS slowest_source, max(length(text)) AS slowest,
      CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(*) FILTER (length(text) % 4 = 0) = 0 THEN 'healthy' WHEN count(*) FILTER (length(text) % 4 = 0) < count(*) THEN 'degraded' ELSE 'unhealthy' END AS verdict FROM conversations""",
    "failure_rate_limit": """WITH RECURSIVE c AS (SELECT user_id % 3 AS store, CAST(floor(event_id / 10) AS BIGINT) AS s, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n FROM events WHERE event_type = 'error'),
      f AS (SELECT store, event_id, n, s AS start, CAST(1 AS BIGINT) AS k, true AS reported FROM c WHERE n = 1
        UNION ALL SELECT c.store, c.event_id, c.n, CASE WHEN s - start >= 60 THEN s ELSE start END, CASE WHEN s - start >= 60 THEN 1 WHEN k < 16 THEN k + 1 ELSE k END, s - start >= 60 OR k < 16 FROM f JOIN c ON c.store = f.store AND c.n = f.n + 1)
      SELECT store, event_id, reported FROM f""",
    "outbox_cursor": "SELECT 'c' || user_id % 4 AS consumer, max(event_id + 1) AS position FROM events GROUP BY 1",
    "outbox_batches": "SELECT page, count(*) AS messages, min(p) AS first_position, max(p) AS cursor_after, count(*) >= 128 AS full FROM (SELECT event_id + 1 AS p, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 128) AS BIGINT) AS page FROM events) GROUP BY page",
    "backoff_schedule": "SELECT range AS attempt, CAST(least(60000, 1000 * pow(2.0, least(range, 40))) AS BIGINT) AS delay_ms FROM range(64)",
    "outbox_poison_skip": "SELECT CAST(floor(event_id / 100) AS BIGINT) AS batch, count(*) AS attempts, count(*) >= 12 AS skipped FROM events WHERE event_type = 'error' GROUP BY 1",
}
