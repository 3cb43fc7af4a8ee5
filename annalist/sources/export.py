"""Ledger export: a header, one JSON line per record by address and revision, and a trailer with counts."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "ledger-export/v1"
KIND = "address string, revision bigint, globalPosition bigint, operation string, status string, schemaVersion int, payload string"


def export_lines(records: DataFrame) -> DataFrame:
    """address, revision and line: flat camel-case JSON without nulls, the payload in base64."""
    payload = F.when(F.col("has_value"), F.base64(F.encode(F.col("value").cast("decimal(20,4)").cast("string"), "UTF-8")))
    body = F.struct("address", "revision", F.col("global_position").alias("globalPosition"), "operation", "status", F.col("schema_version").alias("schemaVersion"), payload.alias("payload"))
    return records.select("address", "revision", F.to_json(body).alias("line"))


def parse_export(lines: DataFrame) -> DataFrame:
    """Records from lines; a line that does not parse has null columns."""
    r = F.from_json("line", KIND)
    return lines.select(r.alias("r")).select("r.address", "r.revision", F.col("r.globalPosition").alias("global_position"), "r.operation", "r.status", F.col("r.schemaVersion").alias("schema_version"), F.decode(F.unbase64("r.payload"), "UTF-8").alias("payload"))


def write_export(records: DataFrame, path: str, root: str, fingerprint: str) -> None:
    """A folder: parts of record lines in order of address and revision, and a header with counts as metadata."""
    ordered = export_lines(records.where(F.lower(F.split("address", "::")[0]) == root.lower())).repartitionByRange("address", "revision").sortWithinPartitions("address", "revision")
    ordered.select("line").write.mode("errorifexists").text(f"{path}/records")
    totals = records.where(F.lower(F.split("address", "::")[0]) == root.lower()).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("address").alias("partitions")).first()
    head = {"format": FORMAT, "root": root, "fingerprint": fingerprint, "records": totals.records, "partitions": totals.partitions}
    records.sparkSession.createDataFrame([(json.dumps(head),)], "line string").coalesce(1).write.text(f"{path}/header")


def read_export(spark: SparkSession, path: str, root: str | None = None, fingerprint: str | None = None) -> DataFrame:
    """Records of an export; everything is checked before a row is returned."""
    head = json.loads(spark.read.text(f"{path}/header").first().value)
    if head.get("format") != FORMAT:
        raise ValueError(f"not a {FORMAT} file")
    if root is not None and head["root"].lower() != root.lower():
        raise ValueError(f"export of root {head['root']}, not {root}")
    if fingerprint is not None and head["fingerprint"] != fingerprint:
        raise ValueError("export of another manifest")
    rows = parse_export(spark.read.text(f"{path}/records").withColumnRenamed("value", "line"))
    bad = F.col("address").isNull() | (F.split("address", "::")[0] != head["root"].lower())
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("address").alias("p"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad")).first()
    if seen.n != head["records"] or seen.p != head["partitions"] or seen.bad:
        raise ValueError(f"damaged export: {seen.n} of {head['records']} records, {seen.bad} foreign or unreadable")
    return rows
