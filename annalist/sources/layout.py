"""Import of the directory layout: <hh>/<digest>/head.json, history/<revision>.json, and a tab-separated change log.

Spark lists and reads the files; heads, history and log come back as the tables that operators.integrity works on.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_address
from ..operators.integrity import parse_log

RECORD = "root string, path string, partition string, revision long, globalPosition long, occurredAt timestamp_ntz, operation string, status string, valueType string, schemaVersion int, payload string, source string, freshUntil timestamp_ntz, serveUntil timestamp_ntz"


def _read(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """One row per file: its parsed record, readable where it parsed."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    r = files.select("file", F.from_json("value", RECORD + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    ok = F.col("r._corrupt").isNull() & F.col("r.revision").isNotNull()
    return r.select("file", F.when(ok, canonical_address(F.col("r.root"), F.col("r.path"), F.col("r.partition"))).alias("address"), F.col("r.revision").alias("revision"), F.col("r.globalPosition").alias("global_position"), "r.operation", "r.status", F.col("r.occurredAt").alias("occurred_at"), F.unbase64("r.payload").alias("payload"), F.coalesce(ok, F.lit(False)).alias("readable"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Records; an unreadable file keeps the revision of its name."""
    h = _read(spark, path, "[0-9]*.json")
    named = F.regexp_extract("file", r"/(\d{20})\.json$", 1).cast("long")
    digest = F.regexp_extract("file", r"/([0-9a-f]{64})/history/", 1)
    return h.withColumn("revision", F.coalesce("revision", named)).withColumn("digest", digest)


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "head.json").where("readable").select("address", "revision", "global_position")


def read_log(spark: SparkSession, path: str, name: str = "_changes.log") -> DataFrame:
    """The parsed change log; lines are numbered in the order of the file. The last line may be torn.

    Spark's readers hide names that start with an underscore, so one task streams the file through pyarrow.
    """

    def lines(batches):
        from pyarrow import fs

        for b in batches:
            for uri in b["uri"]:
                store, at = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
                with store.open_input_stream(at) as f:
                    n, rest = 0, b""
                    while block := f.read(1 << 20):
                        *whole, rest = (rest + block).split(b"\n")
                        if whole:
                            yield pd.DataFrame({"line_no": range(n, n + len(whole)), "text": [x.decode(errors="replace") for x in whole], "last": False})
                        n += len(whole)
                    if rest:
                        yield pd.DataFrame({"line_no": [n], "text": [rest.decode(errors="replace")], "last": [True]})

    uri = spark.createDataFrame([(f"{path.rstrip('/')}/{name}",)], "uri string")
    return parse_log(uri.mapInPandas(lines, "line_no long, text string, last boolean").where("text <> ''"))


def latest(heads: DataFrame, history: DataFrame) -> DataFrame:
    """The newest revision of each address: history goes before a head that is older."""
    both = heads.select("address", "revision").unionByName(history.where("readable").select("address", "revision"))
    return both.groupBy("address").agg(F.max("revision").alias("revision"))
