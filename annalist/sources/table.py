"""A durable ledger table: immutable Parquet files and a log of commits.

data/ holds the files of each commit, _commits/<version>.json what a commit adds and removes and the highest position.
A commit is the exclusive creation of the next version's file, so of several writers one wins and the others read
again. Positions are given inside a commit, above all earlier ones. A reader pins a version. Only the driver commits.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import reads, retention, writes

RETRIES = 8
KIND = "address string, revision long, global_position long, occurred_at timestamp_ntz, operation string, status string, value double, has_value boolean, payload_bytes long, fresh_until timestamp_ntz, serve_until timestamp_ntz, schema_version int, source string, value_type string"


#: Keys of the tables that go with the records: heads (one row an address), sequences, and leases.
HEADS = "address string, revision long, global_position long, occurred_at timestamp_ntz, operation string, status string, value_type string, source string"
SEQUENCES = "name string, value long"
LEASES = "lease_id string, owner string, until timestamp_ntz"


class Conflict(Exception):
    """Another writer committed the version first."""


class LedgerTable:
    capabilities = {"import", "feed", "catalog", "capture", "lag", "lease"}

    def __init__(self, spark: SparkSession, path: str, schema: str = KIND):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        os.makedirs(f"{self.path}/_commits", exist_ok=True)
        os.makedirs(f"{self.path}/data", exist_ok=True)

    # --- versions ---

    def version(self) -> int:
        return max((int(f[:20]) for f in os.listdir(f"{self.path}/_commits") if f.endswith(".json")), default=0)

    def _commit(self, version: int) -> dict:
        with open(f"{self.path}/_commits/{version:020d}.json") as f:
            return json.load(f)

    def state(self, version: int | None = None) -> tuple[list[str], int]:
        """(live data folders, highest position) of a version."""
        version = self.version() if version is None else version
        if not version:
            return [], 0
        c = self._commit(version)
        return c["live"], c["high"]

    def records(self, version: int | None = None) -> DataFrame:
        """The records of a version; a later commit does not change what this returns."""
        live, _ = self.state(version)
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{x}" for x in live))

    def _by_folder(self, version: int) -> DataFrame:
        """The records of a version with the data folder they are in."""
        rows = self.records(version)
        if not self.state(version)[0]:
            return rows.withColumn("folder", F.lit(None).cast("string"))
        return rows.withColumn("folder", F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1))

    def _publish(self, base: int, add: list[str], remove: list[str], high: int) -> int:
        live, _ = self.state(base)
        body = {"live": [x for x in live if x not in remove] + add, "added": add, "removed": remove, "high": high}
        part = f"{self.path}/_commits/.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump(body, f)
        try:
            os.link(part, f"{self.path}/_commits/{base + 1:020d}.json")  # fails where the version exists
        except FileExistsError as e:
            raise Conflict(f"version {base + 1}") from e
        finally:
            os.unlink(part)
        return base + 1

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.sortWithinPartitions("global_position").write.parquet(f"{self.path}/data/{name}")
        return name

    def _retry(self, attempt):
        for i in range(RETRIES):
            try:
                return attempt()
            except Conflict:
                time.sleep(0.01 * 2**i)
        raise Conflict("too many writers")

    # --- writes ---

    def append(self, commands: DataFrame) -> DataFrame:
        """Commands (address, seq, condition, expected, and a record's columns): outcomes by seq, as a written table; accepted ones are committed."""

        def attempt():
            base = self.version()
            _, high = self.state(base)
            heads = reads.read_latest(self.records(base).select("address", "revision", "global_position"))
            heads = heads.join(commands.select("address").distinct(), "address", "left_semi")
            outcomes, folder = writes.conditional_append(commands, heads), f"{self.path}/outcomes/{uuid.uuid4().hex}"
            outcomes.write.parquet(folder)
            outcomes = self.spark.read.schema(outcomes.schema).parquet(folder)
            won = outcomes.where("outcome = 'appended'").select("seq", "revision")
            rows = commands.drop("condition", "expected").join(won, "seq")
            placed = writes.allocate_positions(rows, "seq", high).withColumnRenamed("position", "global_position")
            names = [f.name for f in StructType.fromDDL(self.schema).fields]
            n = won.count()
            if n:
                self._publish(base, [self._write(placed.select(*names))], [], high + n)
            return outcomes

        return self._retry(attempt)

    def import_records(self, imported: DataFrame) -> int:
        """Exact import: replaces records of the same address and revision; positions are kept, the counter rises to them."""
        names = [f.name for f in StructType.fromDDL(self.schema).fields]

        def attempt():
            base = self.version()
            _, high = self.state(base)
            name = self._write(writes.import_exact(self.records(0), imported.select(*names), names).select(*names))
            new = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")
            top = new.agg(F.max("global_position")).first()[0] or 0
            # Only folders that hold a replaced record are written anew.
            keys = new.select("address", "revision")
            old = self._by_folder(base)
            touched = [r.folder for r in old.join(keys, ["address", "revision"], "left_semi").select("folder").distinct().collect()]
            rest = [self._write(old.where(F.col("folder").isin(touched)).join(keys, ["address", "revision"], "left_anti").select(*names))] if touched else []
            return self._publish(base, [name, *rest], touched, max(high, top))

        return self._retry(attempt)

    def prune(self, policy: retention.Policy, now=None) -> int:
        """Retention: a new version with what stays; the feed loses exactly the same records. Folders that lose none stay."""

        def attempt():
            base = self.version()
            _, high = self.state(base)
            old = self._by_folder(base)
            stays = retention.prune(old, policy, now)
            n = old.groupBy("folder").count().join(stays.groupBy("folder").agg(F.count(F.lit(1)).alias("left")), "folder", "left")
            touched = [r.folder for r in n.where("left is null or left < count").select("folder").collect()]
            if not touched:
                return base
            return self._publish(base, [self._write(stays.where(F.col("folder").isin(touched)).drop("folder"))], touched, high)

        return self._retry(attempt)

    def vacuum(self) -> list[str]:
        """Remove data folders that the last version does not hold (pinned older versions end here)."""
        live, _ = self.state()
        gone = [x for x in os.listdir(f"{self.path}/data") if x not in live]
        for x in gone:
            shutil.rmtree(f"{self.path}/data/{x}")
        shutil.rmtree(f"{self.path}/outcomes", ignore_errors=True)
        return gone

    # --- reads ---

    def latest(self, version: int | None = None) -> DataFrame:
        return reads.read_latest(self.records(version))

    def history(self, address: str, take: int = 100, newest_first: bool = True) -> DataFrame:
        return reads.history_of(self.records(), address, take, 1 << 31, newest_first)

    def feed(self, cursor: int = 0, take: int | None = None, version: int | None = None) -> DataFrame:
        return reads.read_feed(self.records(version), cursor, take)

    def catalog(self) -> DataFrame:
        return reads.partition_catalog(self.records())

    def capture(self, refs: DataFrame, version: int | None = None) -> DataFrame:
        """All addresses as of one version: a snapshot over the whole table."""
        return reads.capture(refs, self.records(self.version() if version is None else version))


class Lease:
    """One holder of a name at a time, with an expiry; a stale token neither renews nor releases."""

    def __init__(self, folder: str, clock=time.time):
        self.folder, self.clock = folder, clock
        os.makedirs(folder, exist_ok=True)

    def _read(self, name):
        try:
            with open(f"{self.folder}/{name}.lease") as f:
                return json.load(f)
        except (FileNotFoundError, json.JSONDecodeError):
            return None

    def acquire(self, name: str, ttl: float) -> str | None:
        held = self._read(name)
        if held and held["until"] > self.clock():
            return None
        token, gate = uuid.uuid4().hex, f"{self.folder}/{name}.gate"
        try:
            os.close(os.open(gate, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return None
        try:
            held = self._read(name)
            if held and held["until"] > self.clock():
                return None
            self._put(name, token, ttl)
            return token
        finally:
            os.unlink(gate)

    def _put(self, name, token, ttl):
        part = f"{self.folder}/.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump({"token": token, "until": self.clock() + ttl}, f)
        os.replace(part, f"{self.folder}/{name}.lease")

    def renew(self, name: str, token: str, ttl: float) -> bool:
        held = self._read(name)
        if not held or held["token"] != token or held["until"] <= self.clock():
            return False
        self._put(name, token, ttl)
        return True

    def release(self, name: str, token: str) -> bool:
        held = self._read(name)
        if not held or held["token"] != token:
            return False
        os.unlink(f"{self.folder}/{name}.lease")
        return True
