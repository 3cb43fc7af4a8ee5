"""The change feed of a ledger folder as a stream, its delivery, and a stateful fold per address.

Files of a folder arrive at least once and in no order within a micro-batch; whoever needs the order of positions sorts
inside the batch. Delivery is at least once with a monotonic cursor, and sinks drop messages they have by id.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import outbox
from ..operators.diagnostics import newest


def feed_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a ledger's data folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(path)


class Cursor:
    """A consumer's position in a file; it only moves forward."""

    def __init__(self, path: str):
        self.path = path

    def get(self) -> int:
        try:
            with open(self.path) as f:
                return json.load(f)["position"]
        except FileNotFoundError:
            return 0

    def advance(self, position: int) -> int:
        top = max(self.get(), position)
        part = f"{self.path}.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump({"position": top}, f)
        os.replace(part, self.path)
        return top


class MemorySink:
    """Messages by position: the same id again is dropped, another id at a position is an error."""

    def __init__(self):
        self.messages: dict[int, str] = {}

    def publish(self, rows) -> int:
        new = 0
        for r in rows:
            had = self.messages.get(r.global_position)
            if had is not None and had != r.message_id:
                raise ValueError(f"position {r.global_position} holds {had}, not {r.message_id}")
            new += had is None
            self.messages[r.global_position] = r.message_id
        return new


class Outbox:
    """Reads the feed in pages after the cursor, publishes, and then advances; a page that fails too often is skipped."""

    def __init__(self, cursor: Cursor, sink, page: int = 100, poison_after: int | None = None, lease=None, name: str = "outbox", ttl: float = 30.0):
        self.cursor, self.sink, self.page, self.poison_after = cursor, sink, page, poison_after
        self.lease, self.name, self.ttl, self.failures = lease, name, ttl, (0, 0)

    def run(self, feed) -> str:
        """feed(cursor, take) -> DataFrame of messages in order; until a page is empty. Completed, LeaseUnavailable or LeaseLost."""
        token = self.lease.acquire(self.name, self.ttl) if self.lease else None
        if self.lease and token is None:
            return "LeaseUnavailable"
        try:
            while True:
                start = self.cursor.get()
                rows = feed(start, self.page).collect()  # one page, bounded by its size
                if not rows:
                    return "Completed"
                try:
                    self.sink.publish(rows)
                    self.failures = (start, 0)
                except Exception:
                    n = self.failures[1] + 1 if self.failures[0] == start else 1
                    self.failures = (start, n)
                    if self.poison_after is None or n < self.poison_after:
                        raise
                self.cursor.advance(rows[-1].global_position)
                if self.lease and not self.lease.renew(self.name, token, self.ttl):
                    return "LeaseLost"
        finally:
            if token:
                self.lease.release(self.name, token)


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder of any store holds Parquet files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*.parquet")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def deliver(messages: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True):
    """Streaming delivery to an idempotent table: a batch writes only messages that the table does not have."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        low, high = rows.agg(F.min("global_position"), F.max("global_position")).first()
        if low is None:
            rows.unpersist()
            return
        have = spark.createDataFrame([], "global_position long, message_id string")
        if _has_files(spark, sink_path):  # only the batch's positions: a range that the files' statistics prune
            have = spark.read.parquet(sink_path).where(F.col("global_position").between(low, high))
        if rows.groupBy("global_position").agg(F.min("message_id").alias("a"), F.max("message_id").alias("b")).where("a <> b").limit(1).count():
            raise ValueError("two messages at one position")
        judged = outbox.conflicts_and_new(rows.dropDuplicates(["message_id"]), have)
        if judged.where("outcome = 'conflict'").limit(1).count():
            raise ValueError("another message at a delivered position")
        judged.where("outcome = 'new'").drop("outcome").sortWithinPartitions("global_position").write.mode("append").parquet(sink_path)
        rows.unpersist()

    w = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def subscribe(changes: DataFrame, handler, checkpoint: str, operation: str | None = None):
    """Calls handler(rows in order of position) for each batch of changes, of one operation or of all."""
    rows = changes if operation is None else changes.where(F.col("operation") == operation)
    return rows.writeStream.foreachBatch(lambda df, _: handler(df.orderBy("global_position"))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RevisionFold(StatefulProcessor):
    """The next revision and the last known value of each address, over micro-batches in order of position."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "revision long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        have = self.state.get() if self.state.exists() else (0, None)
        revision, value = have
        pdf = pd.concat(list(rows)).sort_values("global_position")
        out = []
        for position, operation, v in zip(pdf["global_position"], pdf["operation"], pdf["value"]):
            revision += 1
            value = None if operation == "Cleared" else v if operation in ("Set", "Transitioned", "Refreshed") else value
            out.append((key[0], int(position), revision, value))
        self.state.update((revision, value))
        yield pd.DataFrame(out, columns=["address", "global_position", "revision", "value"])

    def close(self) -> None:
        pass


def stream_fold(changes: DataFrame) -> DataFrame:
    """changes (address, global_position, operation, value): revisions and carried values, live. Needs the RocksDB store."""
    return changes.groupBy("address").transformWithStateInPandas(RevisionFold(), "address string, global_position long, revision long, value double", "append", "none")


def fold_of_files(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """stream_fold over all that a stream of files has now, written to the shared folder and read again."""
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    folder = f"{own.rstrip('/')}/annalist-fold-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = stream_fold(changes)
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def bounded_log(failures: DataFrame, most: int = 64) -> DataFrame:
    """The newest failures that a bounded log keeps."""
    return newest(failures, most, F.col("occurred_at").desc(), F.col("global_position").desc())
