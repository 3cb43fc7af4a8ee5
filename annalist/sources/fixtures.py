"""Portable fixtures: a snapshot set as JSON, replayed as writes; and seeds."""

import json

from pyspark.sql import DataFrame, SparkSession

FORMAT = "ledger-fixture/v1"
KIND = "path string, partition string, status string, value double"


def save(snapshots: DataFrame, path: str, root: str, fingerprint: str) -> None:
    """snapshots (path, partition, status, value): a fixture is small by nature, a test's set of states."""
    states = [r.asDict() for r in snapshots.orderBy("path", "partition").collect()]
    with open(path, "w") as f:
        json.dump({"format": FORMAT, "root": root, "manifestFingerprint": fingerprint, "states": states}, f, indent=1)


def load(path: str, root: str | None = None) -> dict:
    with open(path) as f:
        body = json.load(f)
    if body.get("format") != FORMAT or (root is not None and body["root"] != root):
        raise ValueError("not a fixture of this root")
    return body


def apply(spark: SparkSession, body: dict, known: set[str] | None = None, unknown: str = "error") -> DataFrame:
    """Commands (path, partition, seq, operation, value): Set what is held, and mark what is invalidated or cleared."""
    rows, seq = [], 0
    for s in body["states"]:
        if known is not None and s["path"] not in known:
            if unknown == "error":
                raise KeyError(s["path"])
            continue
        if s["value"] is not None:
            rows.append((s["path"], s["partition"], seq, "Set", s["value"]))
            seq += 1
        if s["status"] in ("Invalidated", "Cleared"):
            rows.append((s["path"], s["partition"], seq, s["status"], None))
            seq += 1
    return spark.createDataFrame(rows, "path string, partition string, seq long, operation string, value double")


class Seeds:
    """An ordered list of writes that fill a ledger before use."""

    def __init__(self):
        self.rows = []

    def _add(self, path, partition, operation, value=None):
        self.rows.append((path, partition, len(self.rows), operation, value))
        return self

    def set(self, path, value, partition="default"):
        return self._add(path, partition, "Set", float(value))

    def invalidate(self, path, partition="default"):
        return self._add(path, partition, "Invalidated")

    def clear(self, path, partition="default"):
        return self._add(path, partition, "Cleared")

    def commands(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "path string, partition string, seq long, operation string, value double")
