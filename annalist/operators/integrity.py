"""Verify, compact and repair a ledger kept as heads, history and change log."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import address_digest

# Kinds of findings.
FINDINGS = ("TornChangeLogTail", "MalformedChangeLogLine", "DanglingChangeLogLine", "ChangeLogPositionMismatch", "MissingHead", "MissingHistoryFile", "UnreadableRecordFile", "OrphanedTemporaryFile", "MisplacedStreamDirectory")


def parse_log(lines: DataFrame) -> DataFrame:
    """Lines (line_no, text, last) of five tab-separated fields: position, root, path, partition, revision; ok where they parse."""
    f = F.split("text", "\t")
    field = lambda i: F.try_element_at(f, F.lit(i))
    position, revision = F.try_to_number(field(1), F.lit("999999999999999999")).cast("long"), F.try_to_number(field(5), F.lit("999999999999999999")).cast("long")
    ok = (F.size(f) == 5) & (position > 0) & (revision > 0)
    address = F.concat_ws("::", F.lower(field(2)), field(3), field(4))
    return lines.select("line_no", "text", "last", F.when(ok, position).alias("global_position"), F.when(ok, address).alias("address"), F.when(ok, revision).alias("revision"), F.coalesce(ok, F.lit(False)).alias("ok"))


def verify(heads: DataFrame, history: DataFrame, log: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Findings (kind, address, revision): heads and history (address, revision, global_position, readable), parsed log.

    files (path, address), where given, lists the files under the ledger's folder with the addresses of the records
    inside: temporary files, and directories whose name is not that of their records' address, are findings.
    All three tables meet once, by address and revision; copies of a line are counted before.
    """
    kind = "struct<position:bigint,n:bigint>"
    lines = log.where("ok").groupBy("address", "revision", "global_position").agg(F.count(F.lit(1)).alias("n"))
    none = lambda t: F.lit(None).cast(t)
    rows = lines.select("address", "revision", F.struct(F.col("global_position").alias("position"), "n").alias("line"), none("boolean").alias("readable"), none("long").alias("at"), F.lit(False).alias("head"))
    rows = rows.unionByName(history.select("address", "revision", none(kind).alias("line"), "readable", F.col("global_position").alias("at"), F.lit(False).alias("head")))
    rows = rows.unionByName(heads.select("address", "revision", none(kind).alias("line"), none("boolean").alias("readable"), none("long").alias("at"), F.lit(True).alias("head")))
    both = rows.groupBy("address", "revision").agg(F.collect_list("line").alias("lines"), F.max("readable").alias("readable"), F.max("at").alias("at"), F.max("head").alias("head"))
    absent = F.col("readable").isNull()
    line_kind = lambda x: F.when(absent, "DanglingChangeLogLine").when(F.col("readable") & (x["position"] != F.col("at")), "ChangeLogPositionMismatch")
    of_lines = F.flatten(F.transform("lines", lambda x: F.array_repeat(line_kind(x), x["n"].cast("int"))))
    of_files = F.array(F.when(~F.col("readable"), F.lit("UnreadableRecordFile")), F.when(F.col("head") & absent, F.lit("MissingHistoryFile")))
    out = both.select(F.explode(F.array_compact(F.concat(of_lines, of_files))).alias("kind"), "address", "revision")
    no_head = both.groupBy("address").agg(F.max(F.when(~absent, F.col("revision"))).alias("revision"), F.max("head").alias("head")).where("revision is not null and not head")
    out = out.unionByName(no_head.select(F.lit("MissingHead").alias("kind"), "address", "revision"))
    broken = F.when(F.col("last"), "TornChangeLogTail").otherwise("MalformedChangeLogLine")
    out = out.unionByName(log.where("not ok").select(broken.alias("kind"), none("string").alias("address"), F.col("line_no").cast("long").alias("revision")))
    if files is None:
        return out
    temporary = files.where(F.col("path").endswith(".tmp")).select(F.lit("OrphanedTemporaryFile").alias("kind"), none("string").alias("address"), none("long").alias("revision"))
    folder = F.regexp_extract("path", r"^(?:.*/)?([0-9a-f]{2}/[0-9a-f]{64})/(?:history/)?[^/]+$", 1)
    streams = files.where("address is not null").where(~F.col("path").endswith(".tmp")).select("address", folder.alias("folder")).where("folder <> ''").distinct()
    d = address_digest(F.col("address"))
    astray = streams.where(F.col("folder") != F.concat(F.substring(d, 1, 2), F.lit("/"), d)).select(F.lit("MisplacedStreamDirectory").alias("kind"), "address", none("long").alias("revision"))
    return out.unionByName(temporary).unionByName(astray)


def compact(log: DataFrame, history: DataFrame) -> DataFrame:
    """Log lines that stay, with the reason of each line: keep, dangling, mismatch or duplicate; torn tails stay.

    A line stays where its record is unreadable or has the same position; of equal lines the first stays.
    """
    bad = log.where("not ok and not last").limit(1).count()
    if bad:
        raise ValueError("malformed line inside the change log")
    h = history.select("address", "revision", F.col("global_position").alias("__position"), "readable")
    both = log.where("ok").join(h, ["address", "revision"], "left")
    reason = F.when(F.col("readable").isNull(), "dangling").when(F.col("readable") & (F.col("global_position") != F.col("__position")), "mismatch")
    n = F.row_number().over(Window.partitionBy("address", "revision", "global_position").orderBy("line_no"))
    both = both.withColumn("reason", F.coalesce(reason, F.when(n > 1, "duplicate"), F.lit("keep")))
    tail = log.where("not ok").select("line_no", "text", F.lit("torn").alias("reason"))
    return both.select("line_no", "text", "reason").unionByName(tail)


def compaction_report(compacted: DataFrame) -> DataFrame:
    """Totals by reason: lines and bytes."""
    return compacted.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("text") + 1).cast("long").alias("bytes"))


def repair_plan(heads: DataFrame, history: DataFrame) -> DataFrame:
    """Actions (action, address, revision): quarantine unreadable records, rewrite heads from the newest readable history,
    restore history from heads that have none."""
    good = history.where("readable").groupBy("address").agg(F.max("revision").alias("newest"))
    q = history.where("not readable").select(F.lit("quarantine").alias("action"), "address", "revision")
    h = heads.select("address", F.col("revision").alias("head"))
    both = good.join(h, "address", "left")
    rewrite = both.where(F.col("head").isNull() | (F.col("head") < F.col("newest"))).select(F.lit("rewrite-head").alias("action"), "address", F.col("newest").alias("revision"))
    restore = heads.join(history.where("readable"), ["address", "revision"], "left_anti").select(F.lit("restore-history").alias("action"), "address", "revision")
    return q.unionByName(rewrite).unionByName(restore)
